import corpus_pipeline as C
import pyarrow as pa
from pricequarry.llm import registry
from pricequarry.llm import simhash as S
from pyspark.sql import functions as F

from .conftest import SCHEMA, prose
from .test_minhash import jaccard, shingles


def test_stages_keep_the_columns_and_drop_what_they_should(spark, stored, edge_rows):
    # names that the stages use for columns of their own, in other cases too
    clashing = ("rejected", "LANG_pred", "score", "bits", "digest", "Maybe", "length", "gone", "twice", "key", "class", "kept", "piece", "fp")
    docs = spark.read.parquet(f"{stored}/documents.parquet").withColumns({c: F.lit(i) for i, c in enumerate(clashing)})
    counts = [docs.count()]
    for _, stage in C.STAGES[:-1]:
        docs_next = stage(spark, docs, stored)
        assert docs_next.columns == docs.columns
        assert all(docs_next.where(F.col(c) != i).isEmpty() for i, c in enumerate(clashing) if c in ("rejected", "Maybe", "key"))
        docs = docs_next.cache()
        counts.append(docs.count())
    texts = [r["text"] for r in docs.collect()]
    assert None not in texts and "" not in texts and len(texts) == len(set(texts))
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[3] < counts[2] < counts[1]
    # clean documents all stay
    assert {r[1] for r in edge_rows if r[0] and r[0] >= 20} <= set(texts)


def test_run(spark, stored):
    got = C.run(spark, stored)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns)
    assert got.count() > 0


def test_all_are_registered():
    names = registry.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)


def test_stages_on_an_empty_table(spark, empty, tmp_path):
    docs = empty
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == empty.columns and docs.count() == 0
    assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_near_stage_keeps_no_five_word_near_copy(spark, tmp_path):
    texts = {}
    for i in range(12):
        words = prose(300 + i, 40 + 30 * i).split()
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join([*words[: len(words) // 2], *["lake"] * (1 + i // 4), *words[len(words) // 2 :]])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if b > a and jaccard(sets[a], sets[b]) >= 0.8 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    want = sorted(set(label.values()))
    assert sorted(r["doc_id"] for r in C.near(spark, docs, str(tmp_path)).collect()) == want
    # pairs beyond four bits are among them
    assert len(want) < S.simhash_dedup(docs).count()


def test_near_stage_keeps_other_texts_of_an_id(spark, tmp_path):
    a, b = prose(401, 200), prose(402, 200)
    rows = [(1, a), (7, a + " lake"), (7, b), (None, a), (9, b + " lake")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = C.near(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, a), (7, b), (0, a)])


def test_stages_of_long_texts_get_them_in_small_batches(spark, stored, docs, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []

    def sizes(df, **_):
        rows = df.unionByName(df).coalesce(1).crossJoin(spark.range(0, 60, 1, 1)).select("id").mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
        seen.append((max(r["n"] for r in rows.collect()), rows.agg(F.sum("n")).first()[0]))
        return df

    monkeypatch.setattr(C, "near_dedup", sizes)
    monkeypatch.setattr(C, "pack_documents", sizes)
    C.near(spark, docs, stored)
    C.packed(spark, docs, stored)
    assert [most <= 2_000 for most, _ in seen] == [True, True] and [n for _, n in seen] == [docs.count() * 120] * 2
    assert spark.conf.get(name) == before
