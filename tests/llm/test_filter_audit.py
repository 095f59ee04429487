import itertools
import re

from pricequarry.llm.filter_audit import audit, flags, op11_filter_audit, orders

LABELS = "doc_id long, quality int, toxic int"


def failures(rows):
    """(doc_id, part, failed letters) of each row, straight from the rules."""
    out = []
    for i, text, _, source, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows),
        }
        out.append((i, source or "", {k for k, v in failed.items() if v}))
    return out


def replay(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = failures(rows)
    out, shapley = {}, {}
    for part in {p for _, p, _ in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[1] == part]
            gone = []
            for step, name in enumerate(order, 1):
                here = [d for d in left if name in d[2]]
                redundant = sum(name in d[2] for d in gone)
                unique = sum(d[2] == {name} for d in left + gone)
                left = [d for d in left if name not in d[2]]
                gone += here
                out[part, order, step] = [len(left), len(here), redundant, unique, sum(d[0] in good for d in here), sum(d[0] in toxic for d in here)]
                shapley[part, name] = shapley.get((part, name), 0) + len(here)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_replaying_each_order(spark, edge_rows):
    rows = [*edge_rows, (60, "ABC def # " * 30, None, None, 1), (61, "ABC def # " * 30, None, "", 1), (62, None, None, "u", 0)]
    labels = [(2, 1, 0), (7, 0, 1), (7, 1, 0), (60, None, 1), (61, 1, None), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(audit(flags(docs), spark.createDataFrame(labels, LABELS))) == replay(rows, labels)


def test_columns_of_clashing_names_and_hot_text(spark):
    rows = [(i, "same text", None, "hot", 0) for i in range(200)] + [(300 + i, f"Text {i} $", None, f"s{i % 3}", 0) for i in range(20)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, part int, failed int, least string")
    got = found(audit(flags(docs), spark.createDataFrame([(1, 1, 0)], LABELS)))
    assert got == replay(rows, [(1, 1, 0)])
    assert got["hot", "EABCD", 1][:2] == (1, 199)


def test_empty_tables(spark, empty, docs):
    none = spark.createDataFrame([], LABELS)
    assert audit(flags(empty), none).collect() == []
    assert all(v[4] == v[5] == 0 for v in found(audit(flags(docs), none)).values())


def test_orders(spark):
    rows = orders(spark).collect()
    assert len({r["filter_order"] for r in rows}) == 120
    assert all([s["filter"] for s in r["steps"]] == list(r["filter_order"]) for r in rows)


def test_query(spark, stored, edge_rows):
    spark.createDataFrame([(4, 1, 1)], LABELS).write.mode("overwrite").parquet(f"{stored}/labels.parquet")
    assert found(op11_filter_audit(spark, stored)) == replay(edge_rows, [(4, 1, 1)])
