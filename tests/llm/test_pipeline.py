"""The pipeline against a plain version of it, and every registered query over small tables."""

import hashlib
import random

import pytest
from test_joins import brute_components, brute_lines, words
from test_text_ops import brute_hits

import corpus_pipeline
from weftline.llm import language_id, line_dedup, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, item_id string"


def fixture(spark, folder, empty=False):
    rng = random.Random(12)
    syllables = {"en": ["th", "er", "on", "ing", "a"], "de": ["sch", "ung", "keit", "ei", "ä"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(2, 6)))
    line = lambda lang, n: " ".join(word(lang) for _ in range(n))
    items = [(k, line("en", 14)) for k in range(4)] + [(9, None)]
    rows = []
    for k in range(90):
        lang = "en" if k % 3 else "de"
        text = "\n".join(line(lang, rng.randrange(1, 25)) for _ in range(rng.randrange(1, 6)))
        if k % 11 == 5:
            text += "\n" + rng.choice(items[:4])[1]
        if k % 10 == 7:
            text = rows[rng.randrange(len(rows))][1] or ""
        if k % 10 == 8 and rows[-2][1]:
            text = rows[-2][1].replace(" ", " x ", 1)
        rows.append((k, text, lang if k % 13 else None, f"s{k % 3}", len(text), "clash"))
    rows += [(200, None, "en", "s0", 0, "clash"), (201, "", "en", "s0", 0, "clash"), (202, "12 !", "en", "s1", 4, "clash"), rows[4], (None, line("de", 30), "de", None, 3, "clash")]
    if empty:
        rows, items = [], []
    spark.createDataFrame(rows, COLUMNS).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    pages = [] if empty else [(1, "http://news.example.com/fr/1", "<article><p>One two three four five six, seven eight.</p></article>", "x"), (None, None, None, "x"), (1, "x", "", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string, text string").write.parquet(f"{folder}/pages.parquet")
    return rows, items


def test_pipeline(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    rows, items = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language_id.train(*language_id.sample(docs))
    kept = [r for r in rows if not model.predict(r[1])[2]]
    assert {200, 201, 202}.isdisjoint(r[0] for r in kept) and len(kept) > 80
    lines = {}
    for (d, text, _, gone) in brute_lines([(r[0], r[1]) for r in kept]):
        lines.setdefault(d, []).append((text, gone))
    deduped = []
    for d in sorted({r[0] for r in kept}, key=str):
        for text, gone in lines[str(d)]:
            if not gone or any(len(words(x)) >= line_dedup.LEAST_WORDS for x in text.split("\n")):
                deduped.append((d, text))
    smallest = {}
    for (d, _, component) in brute_components(deduped, corpus_pipeline.SHINGLE, corpus_pipeline.NUM, corpus_pipeline.DEN):
        smallest[d] = component
    single = [x for x in dict.fromkeys(deduped) if smallest[str(x[0])] == str(x[0])]
    clean = [x for x in single if not brute_hits(x[1], items)[1]]
    assert len(deduped) < len(kept) and len(clean) < len(single)
    tokenizer = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    want = [(str(d), len(ids := tokenizer.encode(t, add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for d, t in clean]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in found) == sorted(want)


def test_near_duplicates_of_the_contract(spark):
    """Two words of a hundred replaced: 86 of 106 shingles of five words, 92 of 104 of three."""
    text = [f"w{k}" for k in range(100)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join("x" if k in (30, 60) else w for k, w in enumerate(text)))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [1]


def test_stages_keep_columns(spark, tmp_path):
    fixture(spark, str(tmp_path), empty=True)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")] and docs.isEmpty()
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


@pytest.mark.parametrize("empty", [False, True])
def test_all_queries(spark, tmp_path, empty):
    rows, _ = fixture(spark, str(tmp_path), empty)
    for name, run in queries.queries().items():
        found = run(spark, str(tmp_path))
        assert found.count() == (0 if empty else 3 if "pages" in str(found.inputFiles()) or name in ("op3_url_filter", "op4_html_extract") else len(rows)), name
