from collections import Counter

import pytest

import corpus_pipeline
from reelyard.llm import mixing, toxicity
from tests.llm import test_decontaminate, test_set_join
from tests.llm.cases import odd

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns_of_documents(stages):
    names = list(stages)
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1]) and {"shard", "slot"} <= set(stages[names[-1]].columns)


def test_toxic_documents_go(spark, stages):
    docs = stages["documents"]
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert ids(stages["toxicity"]) == Counter(r["doc_id"] for r in scored if not r["toxic"])


def test_one_of_each_component_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["toxicity"].collect()]
    assert set(ids(stages["n-gram Jaccard join"])) == {c for _, _, c in test_set_join.brute(rows)}


def test_leaks_go(spark, stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["n-gram Jaccard join"].collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in test_decontaminate.brute([(i, t) for i, t in rows if len(t or "") < 2500], items)}
    assert {i for i, t in rows if len(t or "") < 2500 and i not in leaked} <= set(ids(stages["benchmark decontamination"])) and not leaked & set(ids(stages["benchmark decontamination"]))


def test_mix_repeats_whole_documents(stages):
    before, after = stages["benchmark decontamination"], stages["mixing sources to target weights"]
    assert set(ids(after)) <= set(ids(before)) and max(ids(after).values()) <= 2
    size = lambda df: sum(len((r["text"] or "").encode().split()) for r in df.collect())
    assert abs(size(after) / size(before) - 1.5) < 0.25


def test_shards(stages):
    rows = stages["sharding"].collect()
    assert Counter(r["doc_id"] for r in rows) == ids(stages["mixing sources to target weights"])
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_odd_rows_pass_every_stage(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark), SF).count() <= 2 * odd(spark).count()


def test_one_row_of_repeated_and_null_ids_stays(spark):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(5, text), (5, text), (None, text), (None, text), (3, text + " q"), (7, "other words of a text"), (7, "quite another text of words here"), (None, "lone text without an id"), (8, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.jaccard_stage(spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows[4:])
    alone = corpus_pipeline.jaccard_stage(spark, docs.where("doc_id is null or doc_id = 5"), SF)
    assert ids(alone) == {5: 1, None: 1}


def test_every_source_meets_its_target(spark, stages):
    few = [(i % 3 if i % 2 else None, " ".join(["w"] * n), "en", s, n) for s, sizes in {"a": (9000, 4000, 7), "b": (5000,) * 4, "c": (3000, 1, 2), None: (2000, 2000, 10)}.items() for i, n in enumerate(sizes)]
    for docs in (spark.createDataFrame(few, "doc_id long, text string, lang string, source string, n_chars long"), stages["benchmark decontamination"]):
        before, words, longest, rows = docs.collect(), Counter(), Counter(), Counter()
        for r in before:
            n = len((r["text"] or "").encode().split())
            words[r["source"]] += n
            longest[r["source"]] = max(longest[r["source"]], n)
            rows[(r["doc_id"], r["text"], r["source"])] += 1
        targets = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(words.items()), "source string, source_size long")).collect()}
        got, seen = Counter(), Counter()
        for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect():
            got[r["source"]] += len((r["text"] or "").encode().split())
            seen[(r["doc_id"], r["text"], r["source"])] += 1
        assert all(abs(got[s] - targets[s]) <= longest[s] / 2 + 1 for s in words)
        assert all(n <= 2 * rows[k] for k, n in seen.items())


def test_rows_of_files_are_told_apart_by_their_place(spark, tmp_path, monkeypatch):
    odd(spark).unionByName(odd(spark)).repartition(3).write.parquet(str(tmp_path / "odd"))
    docs = spark.read.parquet(str(tmp_path / "odd"))
    rows = corpus_pipeline.placed_rows(docs)
    assert dict(rows.dtypes)["_row"].startswith("struct") and rows.select("_row").distinct().count() == docs.count()
    assert rows.join(corpus_pipeline.placed_rows(docs).select("_row"), "_row").count() == docs.count()
    filtered = corpus_pipeline.placed_rows(docs.where("doc_id > 3"))  # not a table as its files hold it
    assert dict(filtered.dtypes)["_row"] == "bigint"

    def results():
        return [Counter(map(str, stage(spark, docs, SF).collect())) for stage in (corpus_pipeline.mixing_stage, corpus_pipeline.sharding_stage)]

    placed = results()
    monkeypatch.setattr(corpus_pipeline, "placed_rows", corpus_pipeline.numbered)
    assert [sum(c.values()) for c in results()] == [sum(c.values()) for c in placed]
    assert placed[1].total() == docs.count()
