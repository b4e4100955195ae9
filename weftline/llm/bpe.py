"""BPE encoding and decoding as streaming transducers.

Encoding walks the text once. Pre-tokens are stable cuts; inside a pre-token of any length, the merge list's
sufficient lookahead tells how many symbols after a token's end can still change it, so tokens are emitted as
soon as that many symbols have been seen and the window behind them is forgotten. Decoding feeds token bytes
into an incremental byte-to-text state machine.

Sufficient lookahead. Symbols appended on the right can change a merge only through a chain of rules: the first
rule joins across the old end, and each next one, of a later rank, either wanted the piece that the rule before
it took, or wants what that rule has made. Each link reaches left by the length of its rule's left piece. The
longest such chain, found in one pass over the rules from the last rank to the first, bounds the reach.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftline.llm.common import give_back, small_batches, text_blocks

#: Distinct whitespace chunks, and pre-tokens, that a worker remembers before it starts afresh.
CACHE, PIECES = 1 << 18, 1 << 16
#: Characters of a text that are normalised and cut at once, and tokens that are hashed at once.
SEGMENT, FLUSH = 1 << 16, 4096
#: Characters of a pre-token up to which it is encoded at once.
CHUNK = 4096


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Bpe:
    """A tokenizer file's vocabulary, merges and text rules."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models are supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = self.vocab
        self.rank = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made_by, self.never = [ids[a + b] for a, b in merges], len(merges)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if any("\n" in a for a in self.added):
            raise ValueError("added tokens of several lines are not supported")
        self.pieces = {i: s for s, i in [*self.vocab.items(), *self.added.items()]}
        self.joined = " " if not spec.get("decoder") else ""
        self._split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        alphabet = byte_alphabet()
        self.symbols = [self.vocab.get(alphabet[b]) for b in range(256)]
        self.last_symbols = [self.vocab.get(alphabet[b] + self.suffix) for b in range(256)]
        self.steps = self._text_rules(spec)
        self.lookahead = self._sufficient_lookahead()
        self.cache: dict[str, str] = {}
        self.piece_cache: dict[str, list[int]] = {}

    def _text_rules(self, spec: dict) -> regex.Pattern:
        """Checks that the file asks for the rules known here and returns its pre-token pattern."""
        normal = spec.get("normalizer") or {}
        kinds = [n["type"] for n in normal.get("normalizers", [])]
        split, level = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}, {}])
        if kinds != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or not split.get("invert") or split.get("behavior") != "Removed" or level.get("type") != "ByteLevel" or level.get("use_regex") or level.get("add_prefix_space"):
            raise ValueError("unknown text rules")
        return regex.compile(split["pattern"]["Regex"])

    def _sufficient_lookahead(self) -> int:
        length = {i: len(s.removesuffix(self.suffix) if self.suffix else s) for s, i in self.vocab.items()}
        best: dict[int, int] = {}
        most, self.longest = 0, max(length.values(), default=1)
        for (left, right), rank in sorted(self.rank.items(), key=lambda x: -x[1]):
            reach = length[left] + max(best.get(left, 0), best.get(self.made_by[rank], 0))
            best[right] = max(best.get(right, 0), reach)
            most = max(most, reach)
        return most + 1  # one symbol more: whether a symbol ends its word is known from the next one

    def _merge(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost first, over a linked list with a heap."""
        n = len(ids)
        rank, made_by, never = self.rank.get, self.made_by, self.never
        if n < 2:
            return ids
        if n <= 64:
            wait = [rank(pair, never) for pair in zip(ids, ids[1:], strict=False)]
            while wait:
                low = min(wait)
                if low == never:
                    break
                i = wait.index(low)
                made = ids[i] = made_by[low]
                del ids[i + 1], wait[i]
                if i:
                    wait[i - 1] = rank((ids[i - 1], made), never)
                if i < len(wait):
                    wait[i] = rank((made, ids[i + 1]), never)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rule, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rule := rank((ids[i], ids[i + 1]), never)) != never]
        heapq.heapify(heap)
        while heap:
            rule, i, left, right = heapq.heappop(heap)
            j, made = after[i], made_by[rule]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (rule := rank((made, ids[after[j]]), never)) != never:
                    heapq.heappush(heap, (rule, i, made, ids[after[j]]))
            if (h := before[i]) >= 0 and (rule := rank((ids[h], made), never)) != never:
                heapq.heappush(heap, (rule, h, ids[h], made))
        return [x for x in ids if x >= 0]

    def encode_piece(self, raw: bytes, chunk: int = CHUNK):
        """Token ids of one pre-token, emitted once stable; at most chunk + lookahead symbols are held."""
        symbols, n, chunk = self.symbols, len(raw), max(chunk, self.longest)
        if n <= chunk + self.lookahead:
            ids = [symbols[b] for b in raw]
            ids[-1] = self.last_symbols[raw[-1]]
            yield from self._merge([x for x in ids if x is not None])
            return
        at = 0
        while n - at > chunk + self.lookahead:
            seen = raw[at : at + chunk + self.lookahead]
            taken = 0
            for token in self._merge([symbols[b] for b in seen]):
                taken += len(self.pieces[token])
                if taken > chunk:
                    taken -= len(self.pieces[token])
                    break
                yield token
            at += taken
        yield from self.encode_piece(raw[at:], chunk + self.lookahead)

    def _chunk(self, chunk: str) -> str:
        """Ids (joined by spaces) and, in a second line, their surfaces, for text without white space; empty if it has none."""
        out: list[int] = []
        known = self.piece_cache
        for piece in self.steps.findall(chunk):
            found = known.get(piece)
            if found is None:
                found = list(self.encode_piece(piece.encode()))
                if len(piece) <= 64:
                    if len(known) >= PIECES:
                        known.clear()
                    known[piece] = found
            out += found
        pieces = self.pieces
        return " ".join(map(str, out)) + "\n" + self.joined.join([pieces[i] for i in out]) if out else ""

    def _segments(self, text: str):
        """(whitespace chunks after normalisation, False) of pieces of a text, or ([added token], True), in order."""
        spans = [(0, len(text), None)]
        if self._split_added is not None and any(a in text for a in self.added):
            spans, at = [], 0
            for m in self._split_added.finditer(text):
                spans += [(at, m.start(), None), (0, 0, m.group())]
                at = m.end()
            spans.append((at, len(text), None))
        for start, end, token in spans:
            if token is not None:
                yield [token], True
                continue
            while start < end:
                # white space ends a pre-token and takes part in no normalisation, so segments may begin with it
                cut = self.chunks.search(text, start + SEGMENT, end) if end - start > SEGMENT else None
                part, start = text[start : cut.start() if cut else end], cut.start() if cut else end
                yield self._chunks(part), False

    def _chunks(self, part: str) -> list[str]:
        """The whitespace chunks of a piece of text after normalisation."""
        if not part.isascii() and not unicodedata.is_normalized("NFC", part):
            part = unicodedata.normalize("NFC", part)
        part = part.replace("Σ", "σ").lower()
        # str.split also takes four control characters for white space, which the rules don't
        return [x for x in self.chunks.split(part) if x] if self.controls.search(part) else part.split()

    #: White space of the file's rules; any of it ends a pre-token.
    chunks = regex.compile(r"\s+")
    controls = re.compile("[\x1c-\x1f]")

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for parts, added in self._segments(text or ""):
            for part in parts:
                if added:
                    out.append(self.added[part])
                    continue
                for piece in self.steps.findall(part):
                    out.extend(self.encode_piece(piece.encode()))
        return out

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of the ids (joined by spaces) and of the decoded text; what is emitted is hashed and forgotten."""
        total, named, said, machine = 0, hashlib.sha256(), hashlib.sha256(), TextMachine()
        out: list[str] = []

        def flush():
            nonlocal total
            if out:
                lines = "\n".join(out).split("\n")
                ids = " ".join(lines[0::2])
                named.update(((" " if total else "") + ids).encode())
                said.update(machine.feed(((self.joined if total else "") + self.joined.join(lines[1::2])).encode()).encode())
                total += ids.count(" ") + 1
                out.clear()

        cache, emit = self.cache, out.append
        for parts, added in self._segments(text or ""):
            for part in parts:
                if added:
                    emit(f"{self.added[part]}\n{part}")
                elif len(part) > CHUNK:  # no white space in sight: token by token
                    for piece in self.steps.finditer(part):
                        for token in self.encode_piece(piece.group().encode()):
                            emit(f"{token}\n{self.pieces[token]}")
                            if len(out) >= FLUSH:
                                flush()
                else:
                    found = cache.get(part)
                    if found is None:
                        found = self._chunk(part)
                        if len(part) <= 64:
                            if len(cache) >= CACHE:
                                cache.clear()
                            cache[part] = found
                    if found:
                        emit(found)
            if len(out) >= FLUSH:
                flush()
        flush()
        said.update(machine.end().encode())
        return total, named.hexdigest(), said.hexdigest()

    def decode(self, ids) -> str:
        """The text of token ids; ids that the file doesn't have are passed over."""
        machine, out, some = TextMachine(), [], False
        for i in ids:
            if (piece := self.pieces.get(i)) is not None:
                out.append(machine.feed(((self.joined if some else "") + piece).encode()))
                some = True
        return "".join(out) + machine.end()

    def restore(self, ids) -> str:
        """Readable text: word ends become spaces and the byte alphabet is undone, byte by byte."""
        back = {c: b for b, c in byte_alphabet().items()}
        machine, out = TextMachine(), []
        for i in ids:
            piece = self.pieces.get(i, "")
            ended = bool(self.suffix) and piece.endswith(self.suffix)
            raw = bytes(back[c] for c in (piece.removesuffix(self.suffix) if ended else piece) if c in back)
            out.append(machine.feed(raw + b" " * ended))
        return ("".join(out) + machine.end()).removesuffix(" ")


class TextMachine:
    """Bytes in, text out: holds at most the three bytes of an unfinished character; bad bytes give U+FFFD."""

    def __init__(self):
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, raw: bytes) -> str:
        return self._state.decode(raw)

    def end(self) -> str:
        return self._state.decode(b"", True)


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One instance a worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_digest(documents: DataFrame, path: str) -> DataFrame:
    """Per document row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty (no tokens, hashes of the empty string). Very long texts are encoded whole, beside the
    text itself in constant memory. Rows are independent of each other, so repeated rows repeat their result; further
    columns are ignored, whatever their names; an empty table gives an empty result. `path` must be readable on the
    executors.
    """

    def run(batches):
        bpe = load(path)
        for batch in text_blocks(batches):
            found = [bpe.digest(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        # an idle worker keeps the tables, not what it remembers
        bpe.cache.clear()
        bpe.piece_cache.clear()
        give_back()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return small_batches(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(documents: DataFrame, path: str) -> DataFrame:
    """Per document row: doc_id and its token ids."""

    def run(batches):
        bpe = load(path)
        for batch in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")
