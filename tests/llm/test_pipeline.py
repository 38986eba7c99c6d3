"""Each stage of the pipeline on its own input, against a plain version."""

import pytest
from pyspark.sql import functions as F
from test_mixing import pour
from test_ngram_join import brute

import corpus_pipeline
from featurelens.llm import mixing, quality
from featurelens.llm.common import stored, table
from featurelens.llm.queries import KEEP, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(input rows, result) by stage."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, docs, SF), "stage")
        out[name] = docs, result
        docs = result
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_order_and_columns(spark, stages):
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "tokens"]
    columns = table(spark, SF, "documents").columns
    assert all(result.columns == columns for name, (_, result) in stages.items() if name != "tokens")


def test_quality_rejects_what_scores_low(spark, stages):
    docs, result = stages["quality"]
    labels = table(spark, SF, "labels").where(~quality.held_out(F.col("doc_id")))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert set(by_id(result)) == {i for i, s in scores.items() if s >= KEEP}
    bad = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 0").collect()}
    good = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 1").collect()}
    assert len(bad & set(by_id(result))) <= 0.1 * len(bad) and len(good - set(by_id(result))) <= 0.1 * len(good)


def test_one_of_each_text_stays(stages):
    docs, result = stages["exact_dedup"]
    last = {}
    for i, r in sorted(by_id(docs).items()):
        last["".join(c.lower() if c < "\x80" else c for c in r["text"])] = i
    assert set(by_id(result)) == set(last.values())


def test_mix_meets_its_targets(stages):
    docs, result = stages["mixing"]
    sizes, taken, largest = {}, {}, {}
    for r in docs.collect():
        n = len(r["text"].encode().split())
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        largest[r["source"]] = max(n, largest.get(r["source"], 0))
    for r in result.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].encode().split())
    for s, t in pour(sizes, mixing.WEIGHTS, mixing.MAX_EPOCHS).items():
        assert abs(t - taken.get(s, 0)) <= largest[s] + 1e-6


def test_tokens_are_those_of_the_texts(stages):
    tiktoken = pytest.importorskip("tiktoken")
    from featurelens.llm import bpe
    docs, result = stages["tokens"]
    path, pattern = vocabulary()
    with open(path, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = result.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_run_equals_the_stages(spark, stages):
    run = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert run == sorted((r["doc_id"], r["n_tokens"]) for r in stages["tokens"][1].collect())


def test_near_stage_links_from_five_words_and_80_percent(spark, stages):
    docs, result = stages["near_dedup"]
    comps = brute({i: r["text"] for i, r in by_id(docs).items()}, 5, 80)
    assert set(by_id(result)) == {c for _, c in comps.values()}
    base, long = [f"a{i}" for i in range(400)], [f"b{i}" for i in range(500)]
    changed = [f"x{i}" if i % 45 == 22 else w for i, w in enumerate(long)]
    assert sum(a != b for a, b in zip(long, changed, strict=True)) == 11
    apart = [f"y{i}" if i % 40 == 20 else w for i, w in enumerate(long)]
    texts = {1: base, 2: base + [f"e{i}" for i in range(80)], 3: long, 4: changed,
             5: [f"c{i}" for i in range(400)], 6: [f"c{i}" for i in range(400)] + [f"e{i}" for i in range(110)]}
    texts = {i: " ".join(w) for i, w in texts.items()} | {7: " ".join("z" + w for w in apart), 8: " ".join("z" + w for w in long)}
    made = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = set(by_id(corpus_pipeline.without_near_copies(spark, made, SF)))
    assert kept == {c for _, c in brute(texts, 5, 80).values()} != {c for _, c in brute(texts).values()}
    assert {1, 3, 5, 6} <= kept and not {2, 4} & kept
