import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from billweave.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_root(digests):
    """The root over digests and, for each, the digests left and right of its path, level by level."""
    paths, places, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for path, at in zip(paths, places):
            run = at // 8 * 8
            path.append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
        level = [h("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        places = [p // 8 for p in places]
    return (level[0] if level else None), paths


def plain_proofs(rows):
    """``(row, leaf, subroot, root, path)`` of ``rows(doc_id, lang, text)``."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_root([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, tops = plain_root([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            out.append((x[3], x[2], trees[g][0], root, path + top))
    return out


def of_rows(df):
    return merkle.manifest(df, merkle.digest_of(*[merkle.field_of(F.col(c)) for c in ("doc_id", "lang", "text")]), "lang", ["doc_id"])


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(parts)
    made = of_rows(df)
    found = merkle.proofs(made, made.leaves.select("tree", "place", "row"))
    folded = merkle.folded(F.col("reached"), F.col("path"))
    got = found.select("row", "reached", "subroot", "root", "path", folded.alias("folded"), merkle.siblings(F.col("path")).alias("all")).collect()
    want = plain_proofs(rows)
    key = repr
    assert sorted(((tuple(r.row), r.reached, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got), key=key) == sorted(want, key=key)
    assert all(r.folded == r.root and r.all == "".join(a + b for a, b in r.path) for r in got)
    for r in made.records.collect():
        assert r.digest == h("".join(r.children)) and 1 <= len(r.children) <= 8
    return made


def test_many_groups_of_many_sizes(spark):
    """More than one level over the groups, groups of one leaf, of 8, 9, 64, 65 and 600; nulls, ties, copies."""
    rng = random.Random(6)
    rows = [(i, lang, f"text {i} é") for lang, n in [(None, 70), ("en", 600), ("de", 64), ("fr", 65), ("es", 8), ("it", 9), ("", 2)] for i in rng.sample(range(10_000), n)]
    rows += [(i, f"l{i}", None) for i in range(70)]
    rows += [(None, "en", "no id"), (None, "en", None), (3, "en", "a"), (3, "en", "b"), (3, "en", "b"), (4, "ß", "x"), (4, "zz", ""), (5, "-", "x"), (-7, "en", "x")]
    check(spark, rows)


def test_equal_rows_are_leaves_of_their_own(spark):
    made = check(spark, [(1, "en", "copy")] * 700 + [(2, "en", "other")])
    assert made.leaves.count() == 701
    # Equal subtrees are one record: two at the first level, three above it, two at the third, the root.
    assert made.records.count() <= 8


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_one_group(spark, n):
    check(spark, [(i, "en", str(i)) for i in range(n)])


def test_empty(spark):
    made = of_rows(spark.createDataFrame([], "doc_id long, lang string, text string"))
    assert made.root() is None and made.records.count() == 0
    assert merkle.proofs(made, made.leaves.select("tree", "place", "row")).collect() == []


def test_some_requests_only(spark):
    """Single leaves are proved without the others; places that no leaf has get nothing."""
    rows = [(i, "en" if i % 3 else "de", f"t{i}") for i in range(200)]
    made = of_rows(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    asked = spark.createDataFrame([("=en", 0, 1), ("=en", 132, 2), ("=en", 133, 3), ("=de", 8, 4), ("=xx", 0, 5), ("=de", 9999, 6)], "tree string, place long, id int")
    found = merkle.proofs(made, asked.select("tree", "place", F.struct("id").alias("row"))).collect()
    places = {(r[1][1], r[0][0]): r[1:] for r in ((x[0], x[0], x[1], x[2], x[3], x[4]) for x in plain_proofs(rows))}
    assert sorted(r.row.id for r in found) == [1, 2, 4]
    for r in found:
        lang = r.tree[1:]
        ids = sorted(i for i, g, _ in rows if g == lang)
        assert (r.reached, [tuple(s) for s in r.path]) == (places[lang, ids[r.place]][1], places[lang, ids[r.place]][4])


def test_tampering_is_seen(spark):
    rows = [(i, "en", f"Text {i}") for i in range(100)]
    made = of_rows(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    found = merkle.proofs(made, made.leaves.select("tree", "place", "row"))
    other = merkle.digest_of(merkle.field_of(F.col("row.doc_id")), merkle.field_of(F.col("row.lang")), merkle.field_of(F.lower("row.text")))
    assert found.where(merkle.folded(other, F.col("path")) == F.col("root")).count() == 0


def test_columns_of_any_name_and_no_python(spark):
    names = ["tree", "place", "leaf", "row", "key", "part", "at", "n", "spread", "digest"]
    df = spark.createDataFrame([tuple(range(i, i + 10)) for i in range(20)], ", ".join(f"{c} long" for c in names))
    made = merkle.manifest(df, merkle.digest_of(merkle.field_of(F.col("place"))), "tree", ["place", "n"])
    found = merkle.proofs(made, made.leaves.select("tree", "place", "row"))
    assert found.select("row.*").columns == names and found.count() == 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
