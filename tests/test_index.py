"""Snapshots of the index, its maintained text index, and what failures leave behind."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests import oracle
from vellumgrid.operators import search
from vellumgrid.plans import search_queries
from vellumgrid.sources import index
from vellumgrid.sources.store import Store
from vellumgrid.streaming import upserts

SCHEMA = "company string, fiscal_year string, page int, chunk int, scope string, tokens int, text string, vector array<float>"


def chunks(spark, rows):
    return spark.createDataFrame([(c, "FY25", p, 0, "unstated", 3, t, [1.0, 0.0]) for c, p, t in rows], SCHEMA)


def texts(spark, path, version=None):
    return {(r["company"], r["page"], r["text"]) for r in index.open_index(spark, path, "hash", version).collect()}


def hits(spark, path, asked, stored):
    """BM25 over a snapshot, from its text index or from its texts."""
    rows = index.open_index(spark, path, "hash").withColumn("key", F.concat_ws("|", "company", "page"))
    own = index.open_text_index(spark, path) if stored else None
    if own:
        own = search.TextIndex(own.postings.withColumn("key", F.concat_ws("|", F.split("key", "[|]")[0], F.split("key", "[|]")[2])), own.df, own.totals)
    got = search.keyword_topk(None if stored else rows, asked, k=50, stored=own)
    return sorted((r["question_id"], r["key"], round(r["score"], 9), r["rank"]) for r in got.collect())


def prose(rng, n=12):
    return " ".join(rng.choice("assets debt radar ships crore total equity profit loss note tax bank".split()) for _ in range(n))


def test_text_index_follows_replacements(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "i")
    asked = spark.createDataFrame([(1, "total assets"), (2, "radar ships tax zebra"), (3, "")], "question_id int, text string")
    index.write_index(chunks(spark, [(c, p, prose(rng)) for c in "ABCDE" for p in range(1, 5)]), path, "hash", 2)
    assert hits(spark, path, asked, True) == hits(spark, path, asked, False) != []
    steps = [([("B", 1, "zebra radar " + prose(rng)), ("B", 9, None)], ()), ([("F", 1, prose(rng)), ("A", 7, "")], ()), ([("B", 2, "total total total")], ("C", "nobody")), ([], ("D",))]
    for n, (new, gone) in enumerate(steps):
        index.replace_filings(chunks(spark, new), path, gone)
        assert hits(spark, path, asked, True) == hits(spark, path, asked, False), n
        rows = index.open_index(spark, path, "hash")
        own = index.open_text_index(spark, path)
        lengths = search.text_index(rows.withColumn("key", F.concat_ws("|", *index.KEY)))
        assert [tuple(r) for r in own.totals.collect()] == [tuple(r) for r in lengths.totals.select("n_docs", "mean_length").collect()]
        assert {tuple(r) for r in own.df.collect()} == {tuple(r) for r in lengths.df.collect()}
    assert texts(spark, path) & {("C", p, t) for _, p, t in texts(spark, path)} == set()
    before, known = texts(spark, path), {tuple(r) for r in index.open_text_index(spark, path).df.collect()}
    index.compact(spark, path)
    assert texts(spark, path) == before and {tuple(r) for r in index.open_text_index(spark, path).df.collect()} == known and len(index.snapshot(spark, path).segments) == 1
    assert hits(spark, path, asked, True) == hits(spark, path, asked, False)


def test_a_replacement_reads_no_other_text(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    index.write_index(chunks(spark, [(c, 1, f"text of {c}") for c in "ABC"]), path, "hash", 2)
    cut = []
    real = search.term_counts
    monkeypatch.setattr(search, "term_counts", lambda docs, **kw: cut.extend(r["company"] for r in docs.collect()) or real(docs, **kw))
    index.replace_filings(chunks(spark, [("B", 1, "new")]), path)
    assert cut == ["B"]
    index.compact(spark, path)
    assert cut == ["B"]


class Broken(RuntimeError):
    pass


def failing(monkeypatch, at):
    """Let the n-th write, of a table or a small file, a rename or a deletion, fail after it was done (or, negative, before)."""
    count = {"n": 0}

    def wrap(owner, name):
        real = getattr(owner, name)

        def run(*args, **kw):
            count["n"] += 1
            if count["n"] == -at:
                raise Broken
            out = real(*args, **kw)
            if count["n"] == at:
                raise Broken
            return out

        monkeypatch.setattr(owner, name, run)

    wrap(index, "_put")
    for name in ("write", "rename", "delete"):
        wrap(Store, name)
    return count


@pytest.mark.parametrize("change", ["replace", "write", "compact", "prune"])
def test_a_failure_leaves_one_snapshot_or_the_other(spark, tmp_path, change):
    old, rest = [("A", 1, "old a"), ("B", 1, "b")], [("A", 1, "new a"), ("A", 2, "more")]
    act = {
        "replace": lambda path: index.replace_filings(chunks(spark, rest), path),
        "write": lambda path: index.write_index(chunks(spark, rest), path, "hash", 2),
        "compact": lambda path: index.compact(spark, path),
        "prune": lambda path: index.prune(spark, path, 1),
    }[change]
    after = {"replace": {*rest, ("B", 1, "b")}, "write": set(rest), "compact": set(old), "prune": set(old)}[change]
    asked = spark.createDataFrame([(1, "new old a")], "question_id int, text string")
    seen = set()
    for at in (2, 4, 5, -5):
        path = str(tmp_path / f"i{at}")
        index.write_index(chunks(spark, [("A", 1, "older")]), path, "hash", 2)
        index.write_index(chunks(spark, old), path, "hash", 2)
        with pytest.MonkeyPatch.context() as patch:
            count = failing(patch, at)
            try:
                act(path)
                ended = True
            except Broken:
                ended = False
        now = texts(spark, path)
        assert now in (set(old), after) and (not ended or now == after)
        assert index.damaged(spark, path) == []
        assert hits(spark, path, asked, True) == hits(spark, path, asked, False)
        seen.add((now == after, ended))
        act(path)  # and what failed can be done again
        assert texts(spark, path) == after and index.damaged(spark, path) == []
        if count["n"] < abs(at) and at > 0:
            break
    assert len(seen) > 1 or change in ("compact", "prune")


def test_snapshots_pruning_and_damage(spark, tmp_path):
    path = str(tmp_path / "i")
    index.write_index(chunks(spark, [("A", 1, "one"), ("B", 1, "b")]), path, "hash", 2)
    index.replace_filings(chunks(spark, [("A", 1, "two")]), path)
    index.replace_filings(chunks(spark, [("A", 1, "three")]), path)
    assert index.versions(spark, path) == [1, 2, 3] and texts(spark, path, 1) == {("A", 1, "one"), ("B", 1, "b")} and texts(spark, path, 2) == {("A", 1, "two"), ("B", 1, "b")}
    assert index.prune(spark, path, 2) == [1] and index.versions(spark, path) == [2, 3]
    assert texts(spark, path) == {("A", 1, "three"), ("B", 1, "b")} and texts(spark, path, 2) == {("A", 1, "two"), ("B", 1, "b")}
    with pytest.raises(ValueError, match="no index of version 1"):
        index.open_index(spark, path, "hash", 1)
    assert index.prune(spark, path, 1) == [2] and texts(spark, path) == {("A", 1, "three"), ("B", 1, "b")}
    # A file that is in the folder but not in the manifest is not read; a changed and a missing one are found.
    file = index.snapshot(spark, path).files("rows")[0][0]
    folder = os.path.dirname(f"{path}/{file}")
    with open(f"{path}/{file}", "rb") as f:
        content = f.read()
    with open(f"{folder}/part-stray.parquet", "wb") as f:
        f.write(content)
    assert len(texts(spark, path)) == 2 and index.open_index(spark, path, "hash", verify=True).count() == 2
    with open(f"{path}/{file}", "wb") as f:
        f.write(content[:20] + bytes([content[20] ^ 255]) + content[21:])
    assert index.damaged(spark, path, content=False) == [] and index.damaged(spark, path) == [file]
    os.remove(f"{path}/{file}")
    assert index.damaged(spark, path, content=False) == [file]
    with pytest.raises(ValueError, match="damaged"):
        index.open_index(spark, path, "hash", verify=True)


def test_two_writers(spark, tmp_path, monkeypatch):
    """The writer that comes second starts again from the other's snapshot; neither change is lost."""
    path = str(tmp_path / "i")
    index.write_index(chunks(spark, [("A", 1, "a"), ("B", 1, "b")]), path, "hash", 2)
    real, between = index._segment, [lambda: index.replace_filings(chunks(spark, [("B", 1, "theirs")]), path)]

    def slowly(*args):
        out = real(*args)
        if between:
            between.pop()()
        return out

    monkeypatch.setattr(index, "_segment", slowly)
    index.replace_filings(chunks(spark, [("A", 1, "mine")]), path)
    assert texts(spark, path) == {("A", 1, "mine"), ("B", 1, "theirs")} and index.versions(spark, path) == [1, 2, 3]


def test_odd_names_and_many_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MAX_SEGMENTS", 3)
    path, names = str(tmp_path / "i"), ["001", "M&M / a=b", "100%", "é {x}", "1e5"]
    index.write_index(chunks(spark, [(n, 1, f"text {i}") for i, n in enumerate(names)]), path, "hash", 2)
    for i, n in enumerate(names):
        index.replace_filings(chunks(spark, [(n, 2, f"new {i}")]), path)
    assert texts(spark, path) == {(n, 2, f"new {i}") for i, n in enumerate(names)}
    assert len(index.snapshot(spark, path).segments) <= 3 and index.damaged(spark, path) == []
    with pytest.raises(Exception, match="no company"):
        index.replace_filings(chunks(spark, [(None, 1, "x")]), path)
    with pytest.raises(ValueError, match="lack"):
        index.replace_filings(chunks(spark, [("A", 1, "x")]).drop("page"), path)


def test_plans_of_keyword_search(spark):
    """No window by term anywhere, and a term's postings are only counted."""
    docs = spark.createDataFrame([(i, "same word everywhere") for i in range(50)], "key int, text string")
    got = search.keyword_topk(docs, spark.createDataFrame([(1, "word")], "question_id int, text string"))
    assert got.count() == 50
    plan = search.text_index(docs).df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_count" in plan


@pytest.mark.parametrize("bound", [48 << 20, -1])
def test_vector_blocks_are_dealt_by_company(spark, monkeypatch, bound):
    monkeypatch.setattr(search, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(search, "BLOCK_ROWS", 3)
    rng = random.Random(4)
    rows = [(i, f"C{i % 4}" if i % 9 else None, rng.choice(["standalone", "consolidated", "mixed", "unstated"]), [rng.random() - 0.5 for _ in range(3)]) for i in range(60)]
    asked = [(f"q{i}", rng.choice(["C0", "C1", "C9", None]), rng.choice([None, "standalone"]), [rng.random() - 0.5 for _ in range(3)]) for i in range(20)]
    expected = set()
    for q, of, scope, v in asked:
        own = [(-sum(a * b for a, b in zip(v, w, strict=True)), k) for k, c, s, w in rows if of in (None, c) and (scope is None or s in (scope, "mixed", "unstated"))]
        expected |= {(q, k, i + 1) for i, (_, k) in enumerate(sorted(own)[:5])}
    index_ = spark.createDataFrame(rows, "key int, company string, scope string, vector array<double>")
    questions = spark.createDataFrame(asked, "question_id string, of string, scope_asked string, vector array<double>")
    got = search.vector_topk(index_, questions, k=5, company="of", scope="scope_asked")
    assert {(r["question_id"], r["key"], r["rank"]) for r in got.collect()} == expected
    assert search.vector_topk(index_, questions.limit(0), k=5, company="of").count() == 0


def sent(spark, *rows):
    """(company, page, text, sha256, n_chunks, arrived)"""
    frame = chunks(spark, [r[:3] for r in rows])
    return spark.createDataFrame([(*c, *r[3:]) for c, r in zip(frame.collect(), rows, strict=True)], f"{SCHEMA}, sha256 string, n_chunks int, arrived long")


def test_one_version_of_a_company(spark, tmp_path):
    """Two checksums of one company, whole in one batch: the later one is in the index, whole and alone."""
    path = str(tmp_path / "i")
    index.write_index(chunks(spark, [("A", 1, "a"), ("B", 1, "b")]), path, "hash", 2)
    upserts.put_whole(sent(spark, ("A", 1, "late 1", "s1", 2, 20), ("A", 2, "late 2", "s1", 2, 21), ("A", 1, "early", "s9", 1, 10), ("B", 1, "half", "s5", 2, 12)), path)
    assert texts(spark, path) == {("A", 1, "late 1"), ("A", 2, "late 2"), ("B", 1, "b")}
    # An older version that becomes whole later does not come back; the newest does.
    upserts.put_whole(sent(spark, ("A", 1, "early", "s9", 1, 10), ("A", 1, "newest", "s0", 2, 30)), path)
    assert texts(spark, path) == {("A", 1, "late 1"), ("A", 2, "late 2"), ("B", 1, "b")}
    upserts.put_whole(sent(spark, ("A", 2, "newest", "s0", 2, 31), ("B", 2, "other half", "s5", 2, 40)), path)
    assert texts(spark, path) == {("A", 1, "newest"), ("A", 2, "newest"), ("B", 1, "half"), ("B", 2, "other half")}
    index_version = index.versions(spark, path)[-1]
    upserts.put_whole(sent(spark, ("A", 1, "again", "s0", 1, 50)), path)
    assert index.versions(spark, path)[-1] == index_version


def test_a_batch_that_fails_is_sent_again(spark, tmp_path):
    """Whatever write fails, what waited from earlier batches is there when the batch comes again."""
    first = [("A", 1, "one", "s1", 2, 1), ("B", 1, "b one", "s2", 3, 1)]
    second = [("A", 2, "two", "s1", 2, 2), ("B", 2, "b two", "s2", 3, 2)]
    third = [("B", 3, "b three", "s2", 3, 3)]
    for at in (4, 5, 6, 7):
        path = str(tmp_path / f"i{at}")
        index.write_index(chunks(spark, [("A", 9, "old")]), path, "hash", 2)
        upserts.put_whole(sent(spark, *first), path)
        with pytest.MonkeyPatch.context() as patch:
            count = failing(patch, at)
            try:
                upserts.put_whole(sent(spark, *second), path)
            except Broken:
                pass
        assert texts(spark, path) in ({("A", 9, "old")}, {("A", 1, "one"), ("A", 2, "two")})
        upserts.put_whole(sent(spark, *second), path)
        assert texts(spark, path) == {("A", 1, "one"), ("A", 2, "two")}
        upserts.put_whole(sent(spark, *third), path)
        assert texts(spark, path) == {("A", 1, "one"), ("A", 2, "two"), ("B", 1, "b one"), ("B", 2, "b two"), ("B", 3, "b three")}
        if count["n"] < at:
            break
    assert at == 7


@pytest.mark.parametrize("rows", [2, 256])
def test_keyword_search_scores_documents_where_they_stand(spark, tmp_path, monkeypatch, rows):
    """Ids that repeat, ties and empty texts as in the SQL, and no row a document and question is dealt out."""
    monkeypatch.setattr(search, "SCORED_ROWS", rows)
    rng = random.Random(11)
    texts = [prose(rng, rng.choice([1, 4, 30])) for _ in range(120)] + [None, "", "?", "total", "total"]
    ids = [i % 110 for i in range(len(texts))]
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * len(ids), "source": ["src1"] * len(ids)})
    asked = pa.table({"item_id": pa.array(range(6), pa.int64()), "text": ["total assets", "TOTAL tax tax", "zebra", "", None, "a bank of ships and debt"]})
    for name, table in (("documents", docs), ("benchmark", asked)):
        pq.write_table(table, tmp_path / f"{name}.parquet")
    run = search_queries.QUERIES["keyword_topk_bm25"]
    assert oracle.compare(run, search_queries.ORACLE_SQL["keyword_topk_bm25"], spark, str(tmp_path), oracle.connect(str(tmp_path))) == 150
    plan = run(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan


def test_texts_of_a_context_stay_where_they_are(spark):
    """The few hits go to the documents, also where the optimiser would deal both out."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = search_queries.QUERIES["answer_in_context"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(key" not in plan


def test_terms_are_counted_in_their_rows(spark):
    """Rows that share a key and a length are counted together; nothing else is dealt out."""
    rows = [(1, "b a b"), (2, ""), (3, None), (4, "x X, x"), (5, "a"), (5, "b a"), (6, "c d"), (6, "d e")]
    expected = Counter()
    for key, text in rows:
        terms = re.findall(r"\w+", (text or "").lower())
        for term in terms:
            expected[key, len(terms), term] += 1
    count = lambda rows: search.term_counts(spark.createDataFrame(rows, "key int, text string"))
    assert {(r["key"], r["length"], r["term"]): r["tf"] for r in count(rows).collect()} == expected
    assert "Exchange" not in count(rows[:5])._jdf.queryExecution().executedPlan().toString()
