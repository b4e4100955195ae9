"""URL filters: rules by host and path prefix, and gradient-boosted trees on lexical features for the rest.

No table labels URLs, so the labelled ones are made here by a rule: two families of sites whose lengths, depths, digits,
entropies, parameters and suffixes are drawn from different but overlapping distributions. No feature looks at words,
so the trees judge shapes alone. `train` takes any other labelled URLs alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import text_blocks

#: (verdict, host and path) of the contract; a rule fits its host and all subdomains.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST_END, _PATH_END = re.compile("[/?#]"), re.compile("[?#]")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Both empty for a null url or one without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = m.start() if (m := _HOST_END.search(rest)) else len(rest)
    path = rest[end:]
    return rest[:end].translate(_LOWER), path[: m.start()] if (m := _PATH_END.search(path)) else path


class Rules:
    """The longest rule that fits, found by the host's label suffixes; of equally long ones the later one."""

    def __init__(self, rules=RULES):
        self.by_host = defaultdict(list)
        for verdict, text in rules:
            host, slash, path = text.partition("/")
            self.by_host[host].append((slash + path, text, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, verdict = None, None
        labels = host.split(".") if host else []
        for k in range(len(labels)):
            for prefix, text, said in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(prefix) and (best is None or len(text) >= len(best)):
                    best, verdict = text, said
        return best, verdict


_TOKEN = re.compile("[a-z]+|[0-9]+")
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "host_hyphens", "digit_ratio", "host_digit_ratio", "host_entropy", "path_entropy", "parameters", "query_length", "longest_token", "escapes", "suffix_odds")


def entropy(text: str) -> float:
    """Shannon entropy of the characters, in bits."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


class Odds:
    """Smoothed log odds of being blocked by host suffix (the last label); a suffix never seen has none."""

    def __init__(self, hosts: list[str], blocked: np.ndarray, smooth: float = 4.0):
        bad, all_ = Counter(), Counter()
        for host, y in zip(hosts, blocked.tolist(), strict=True):
            key = host.rpartition(".")[2]
            all_[key] += 1
            bad[key] += y
        self.suffix = {key: math.log((bad[key] + smooth) / (n - bad[key] + smooth)) for key, n in all_.items()}

    def of(self, host: str) -> float:
        return self.suffix.get(host.rpartition(".")[2], 0.0)


def features(url: str, odds: Odds) -> list[float]:
    host, path = host_and_path(url)
    query = url.partition("?")[2].partition("#")[0]
    digits = sum(c.isdigit() for c in url)
    tokens = _TOKEN.findall(url.translate(_LOWER))
    return [
        len(url), len(host), len(path), sum(map(bool, path.split("/"))), host.count(".") + 1 if host else 0, host.count("-"),
        digits / max(1, len(url)), sum(c.isdigit() for c in host) / max(1, len(host)), entropy(host), entropy(path),
        sum(map(bool, query.split("&"))), len(query), max(map(len, tokens), default=0), url.count("%"), odds.of(host),
    ]


class Boosted:
    """Logistic gradient boosting of small trees, split on quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 8, ridge: float = 1.0):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(self.cuts)], 1)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.trees = math.log(p / (1 - p)), []
        f = np.full(len(y), self.base)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-f))
            tree: list[tuple] = []
            step = np.zeros(len(y))
            self._grow(tree, binned, y - q, q * (1 - q), np.arange(len(y)), depth, least, ridge, step)
            self.trees.append(tree)
            f += rate * step
        self.rate = rate

    def _grow(self, tree, binned, g, h, rows, depth, least, ridge, step) -> int:
        """Appends a node and those below it; returns its number."""
        number = len(tree)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth:
            for j, cuts in enumerate(self.cuts):
                if not len(cuts):
                    continue
                sums_g = np.cumsum(np.bincount(binned[rows, j], g[rows], len(cuts) + 1))[:-1]
                sums_h = np.cumsum(np.bincount(binned[rows, j], h[rows], len(cuts) + 1))[:-1]
                counts = np.cumsum(np.bincount(binned[rows, j], minlength=len(cuts) + 1))[:-1]
                gain = sums_g**2 / (sums_h + ridge) + (total_g - sums_g) ** 2 / (total_h - sums_h + ridge) - total_g**2 / (total_h + ridge)
                gain[(counts < least) | (len(rows) - counts < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        if best[1] is None:
            tree.append(("leaf", total_g / (total_h + ridge)))
            step[rows] = tree[-1][1]
            return number
        _, j, k = best
        tree.append(None)
        low = binned[rows, j] <= k
        left = self._grow(tree, binned, g, h, rows[low], depth - 1, least, ridge, step)
        right = self._grow(tree, binned, g, h, rows[~low], depth - 1, least, ridge, step)
        tree[number] = (j, self.cuts[j][k], left, right)
        return number

    def splits(self) -> Counter:
        """How many nodes split on each feature."""
        return Counter(FEATURES[node[0]] for tree in self.trees for node in tree if node[0] != "leaf")

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of being blocked."""
        f = np.full(len(x), self.base)

        def walk(tree, number, rows):
            node = tree[number]
            if node[0] == "leaf":
                f[rows] += self.rate * node[1]
                return
            low = x[rows, node[0]] <= node[1]
            walk(tree, node[2], rows[low])
            walk(tree, node[3], rows[~low])

        for tree in self.trees:
            walk(tree, 0, np.arange(len(x)))
        return 1 / (1 + np.exp(-f))


#: Suffixes of the labelled URLs by family, with their weights: both families use most of them.
ORDINARY_SUFFIXES = {"com": 40, "org": 14, "net": 10, "edu": 5, "gov": 3, "io": 4, "info": 4, "uk": 6, "de": 7, "fr": 6, "es": 5, "xyz": 1, "top": 1, "biz": 1}
BLOCKED_SUFFIXES = {"com": 28, "org": 3, "net": 10, "io": 2, "info": 12, "uk": 1, "de": 2, "fr": 2, "es": 2, "xyz": 14, "top": 12, "biz": 6, "click": 6}
_VOWELS, _CONSONANTS, _MIXED = "aeiou", "bcdfghjklmnprstvwz", "abcdefghijklmnopqrstuvwxyz0123456789"


def labelled_urls(n: int = 6000, seed: int = 5) -> tuple[list[str], np.ndarray]:
    """URLs and whether to block them, one in three, by the module's rule.

    Ordinary sites have short pronounceable names, paths of words, dates or numbers, few parameters. Blocked ones have
    longer hosts with more labels, hyphens and digits, random strings, deep paths, many parameters. Every trait of the
    one family occurs in the other, less often, and the traits of a site are drawn independently.
    """
    rng = np.random.default_rng(seed)
    chance = lambda ordinary, blocked: rng.random() < (blocked if bad else ordinary)
    few = lambda ordinary, blocked: int(rng.poisson(blocked if bad else ordinary))
    drawn = lambda letters, k: "".join(letters[i] for i in rng.integers(len(letters), size=k))

    def word():
        return "".join(drawn(_CONSONANTS, 1) + drawn(_VOWELS, 1) + drawn(_CONSONANTS, int(rng.integers(2))) for _ in range(int(rng.integers(1, 4))))

    def part():
        """A segment of a path: a random string, a number, a slug or a word."""
        if chance(0.08, 0.35):
            return drawn(_MIXED, int(rng.integers(6, 28)))
        if chance(0.25, 0.3):
            return drawn("0123456789", int(rng.integers(1, 9 if bad else 6)))
        return "-".join(word() for _ in range(1 + few(0.8, 0.8))) + (".html" if chance(0.15, 0.15) else "")

    urls, blocked = [], []
    for k in range(n):
        bad = k % 3 == 0
        name = drawn(_MIXED, int(rng.integers(8, 22))) if chance(0.04, 0.3) else "-".join(word() for _ in range(1 + few(0.25, 1.3)))
        name += drawn("0123456789", int(rng.integers(1, 5))) if chance(0.05, 0.3) else ""
        labels = [word() for _ in range(few(0.35, 0.9))]
        ends = BLOCKED_SUFFIXES if bad else ORDINARY_SUFFIXES
        suffix = list(ends)[int(rng.choice(len(ends), p=np.array(list(ends.values())) / sum(ends.values())))]
        path = "".join("/" + part() for _ in range(few(2.0, 3.2))) + ("/" if chance(0.4, 0.4) else "")
        if chance(0.04, 0.2):
            path += "%" + drawn("0123456789ABCDEF", 2) + word()
        query = "&".join(f"{word()[:4]}={drawn(_MIXED if chance(0.3, 0.7) else _CONSONANTS, int(rng.integers(1, 14 if bad else 8)))}" for _ in range(few(0.35, 1.8)))
        urls.append(("https://" if chance(0.8, 0.6) else "http://") + ".".join([*labels, name, suffix]) + path + ("?" + query if query else ""))
        blocked.append(bad)
    return urls, np.array(blocked, float)


class Filter:
    """Rules first, trees for the rest, those without a host included."""

    def __init__(self, odds: Odds, trees: Boosted, rules=RULES, bound: float = 0.5):
        self.odds, self.trees, self.rules, self.bound = odds, trees, Rules(rules), bound

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str, float]]:
        """(host, path, rule or None, verdict, probability of being blocked) of each url."""
        scores = self.trees.predict(np.array([features(u or "", self.odds) for u in urls], float).reshape(len(urls), len(FEATURES)))
        out = []
        for url, score in zip(urls, scores.tolist(), strict=True):
            host, path = host_and_path(url)
            rule, verdict = self.rules.find(host, path)
            out.append((host, path, rule, verdict or ("block" if score >= self.bound else "allow"), score))
        return out


def train(urls: list[str], blocked: np.ndarray, rules=RULES) -> Filter:
    """Suffix statistics come from one half of the labelled URLs, the trees from the other, so that they don't trust them too much."""
    half = np.arange(len(urls)) % 2 == 0
    odds = Odds([host_and_path(u)[0] for u, h in zip(urls, half, strict=True) if h], blocked[half])
    x = np.array([features(u, odds) for u, h in zip(urls, half, strict=True) if not h], float)
    return Filter(odds, Boosted(x, blocked[~half]), rules)


def judge_pages(pages: DataFrame, model: Filter | None = None) -> DataFrame:
    """Per page row: page_id, host, path, rule, verdict, score.

    A null url, or one without ://, has an empty host and path and no rule, and is judged by the trees as it stands (a
    null one like an empty one). Very long urls are judged whole. Of equally long rules the later one wins; a
    probability just at the bound blocks. Repeated rows repeat their result; further columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    handle = pages.sparkSession.sparkContext.broadcast(model or train(*labelled_urls()))

    def run(batches):
        for batch in text_blocks(batches, "url"):
            columns = list(zip(*handle.value.judge(batch.column("url").to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.float64() if k == 4 else pa.string()) for k, c in enumerate(columns))], ["page_id", "host", "path", "rule", "verdict", "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
