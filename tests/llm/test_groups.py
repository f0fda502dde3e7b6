import importlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from marrow.llm import groups, near_dedup, queries, shingles, vector_graph  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DATA = "/root/testdata/sf0.001"


def bag(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def alike(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def smallest(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def by_brute_force(rows, threshold=0.8):
    rows = sorted({i: t or "" for i, t in rows if i is not None}.items())
    bags = {i: bag(t) for i, t in rows}
    text = dict(rows)
    pairs = [(a, b) for k, (a, _) in enumerate(rows) for b, _ in rows[k + 1 :]]
    return smallest(text, [(a, b) for a, b in pairs if (alike(bags[a], bags[b]) >= threshold if bags[a] and bags[b] else text[a] == text[b])])


def near_copies(seed, families=12, members=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(20, 120))] * rng.choice([1, 1, 3])
        for _ in range(members):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = word()
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, bucket string, own int")
    return [(r.doc_id, r.class_id) for r in near_dedup.classes(df).collect()]


def test_shingles_are_those_of_the_words():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "B", "cé", "d1", "日"]) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", "x", "..."]
    doc, h, count = shingles.bags(texts)
    names = {}
    for i, t in enumerate(texts):
        want = bag(t)
        assert sorted(want.values()) == sorted(count[doc == i])
    for i, t in enumerate(texts):  # equal shingles have equal hashes and others don't
        for k, n in bag(t).items():
            names.setdefault((k, n), set()).update(x for x, c in zip(h[doc == i], count[doc == i]) if c == n)
    assert len({x for s in names.values() for x in s}) == len({k for k, _ in names})


def test_signatures_are_unbiased():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(5, 60))) for _ in range(120)]
    texts += ["q w e r t " * 40, "q w e r t " * 30]
    sig = near_dedup.signatures(*shingles.bags(texts), len(texts))
    bags = [bag(t) for t in texts]
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(2000)] + [(120, 121)] * 5
    error = [(sig[a] == sig[b]).mean() - alike(bags[a], bags[b]) for a, b in pairs if a != b]
    assert abs(np.mean(error)) < 0.01 and max(map(abs, error)) < 0.25


@pytest.mark.parametrize("registers", [near_dedup.REGISTERS, near_dedup.SKETCH])
def test_signatures_do_not_depend_on_company(monkeypatch, registers):
    """A text's signature is its own, however many points of its block are drawn at a time."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.choice([0, 1, 7, 60, 900]))) for _ in range(30)] + ["q w e r t " * 400]
    together = near_dedup.signatures(*shingles.bags(texts), len(texts), registers)
    alone = [near_dedup.signatures(*shingles.bags([t]), 1, registers)[0] for t in texts]
    monkeypatch.setattr(near_dedup, "POINTS_AT_ONCE", 1)
    singly = near_dedup.signatures(*shingles.bags(texts), len(texts), registers)
    assert np.array_equal(together, alone) and np.array_equal(together, singly)


def test_near_duplicates_match_brute_force(spark):
    rows = near_copies(5) + [(1000, None), (1001, ""), (1002, "..."), (1003, "..."), (1004, "one two"), (1005, "One, two!"), (1006, "word " * 30_000), (1007, "word " * 30_000 + "end")]
    assert dict(found(spark, rows)) == by_brute_force(rows)


def test_near_duplicates_stand_null_and_repeated_ids(spark):
    got = Counter(found(spark, [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (1, "A b c d e f.")]))
    assert got == Counter([(3, 1), (3, 1), (None, None), (1, 1)])
    assert found(spark, []) == []


def test_families_around_the_threshold(spark):
    """Long shared passages with own parts of many lengths: links and near misses in the same buckets."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(100)]
    rows = [(i, " ".join(passage + [word() for _ in range(rng.randint(0, 60))])) for i in range(80)]
    assert dict(found(spark, rows)) == by_brute_force(rows)


def test_more_leaders_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MANY_MEMBERS", 0)
    monkeypatch.setattr(near_dedup, "PAIRS_IN_GROUP", 3)
    monkeypatch.setattr(near_dedup, "BUCKET_SHARE", 3)
    rows = near_copies(6, families=4)
    assert dict(found(spark, rows)) == by_brute_force(rows)


def test_a_dense_group_takes_few_comparisons(spark, monkeypatch):
    """Copies of one text, each with edits of its own: far more pairs are alike than it takes to connect them."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(300)], []
    for i in range(250):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    made, verified = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda docs, pairs, threshold: made.append(pairs.select("a", "b").distinct().count()) or verified(docs, pairs, threshold))
    assert dict(found(spark, rows)) == by_brute_force(rows)
    assert sum(made[1:]) < 2 * len(rows)  # the first are the pairs with leaders


def test_near_sketches_are_all_found(spark):
    """Buckets in one share and in several, over many Arrow batches, against brute force."""
    rng = np.random.default_rng(4)
    rows = []
    for bucket, size, shares in ((1, 30, 1), (2, 40, 3), (3, 1, 1), (4, 25, 5)):
        base = rng.integers(0, 256, near_dedup.SKETCH // 8, np.uint8)
        for _ in range(size):
            flips = (rng.random((near_dedup.SKETCH // 8, 8)) < rng.choice([0.02, 0.05, 0.08])).astype(np.uint8)
            i = len(rows)
            bands = [int(rng.integers(0, 3)) if k < 2 else 1000 * i + k for k in range(near_dedup.BANDS)]
            rows.append((bucket, i, i - i % 2, int(rng.integers(80, 130)), 2, bands, shares, bytearray((base ^ np.packbits(flips, axis=1)[:, 0]).tobytes())))
    df = spark.createDataFrame(rows, "bucket long, id long, own long, n long, band int, bands array<long>, shares long, sketch binary")
    most = int(2048 * 0.1 + (2048 * 0.1 * 0.9) ** 0.5)
    bits = lambda r: int.from_bytes(r[7], "big")
    near = {(a[1], b[1]) for a in rows for b in rows if a[:1] == b[:1] and a[1] < b[1] and a[2] != b[2] and min(a[3], b[3]) >= 0.8 * max(a[3], b[3]) and (bits(a) ^ bits(b)).bit_count() <= most}
    again = {(a, b) for a, b in near if any(x == y for x, y in zip(rows[a][5][:2], rows[b][5][:2], strict=True))}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        every, sparse = ([tuple(r) for r in near_dedup._across(df, 0.8, 1, x).collect()] for x in (False, True))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert again and len(near) > 300 and sorted(every) == sorted(near - again)
    own = {r[1]: r[2] for r in rows}
    assert set(sparse) <= near and len(sparse) < len(near) / 3
    joined = lambda pairs: smallest(set(own.values()), [(own[a], own[b]) for a, b in pairs])
    assert joined(sparse) == joined(near)


@pytest.mark.parametrize("in_task", [0, 1_000_000])
def test_components(spark, monkeypatch, in_task):
    monkeypatch.setattr(groups, "EDGES_IN_TASK", in_task)
    monkeypatch.setattr(groups, "HOT_ROWS", 5)
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200, 201 + i) for i in range(12)] + [(300 + i, 301 + i) for i in range(15)] + [(5, 5)]
    got = {r.id: r.component for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = smallest({x for e in edges for x in e}, edges)
    assert got == {i: want[i] for i in {x for a, b in edges if a != b for x in (a, b)}}
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_lookups(spark, monkeypatch):
    monkeypatch.setattr(groups, "HOT_ROWS", 2)
    rows = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 0), (3, 0), (None, 0)], "k long, x long")
    entries = spark.createDataFrame([(1, "one", 9), (2, "two", 1)], "k long, v string, n long")
    got = Counter((r.k, r.v) for r in groups.look_up(rows, entries, ["k"], "v", "n").collect())
    assert got == Counter({(1, "one"): 9, (2, "two"): 1, (3, None): 1, (None, None): 1})


# vectors
def linked(rows, cosine=0.9):
    unit = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, float) / max(map(abs, v))
            unit[i] = a / np.linalg.norm(a)
    ids = sorted(unit)
    x = np.array([unit[i] for i in ids])
    hit = np.triu(x @ x.T >= cosine, 1)
    pairs = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit), strict=True)]
    degree = Counter(x for p in pairs for x in p)
    everyone = [i for i, _ in rows if i is not None]
    return {i: (degree[i], c) for i, c in smallest(everyone, pairs).items()}


def clouds(seed, n=400):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=16) for _ in range(n)]
    for k in range(12):
        rows += [rows[k] + rng.normal(size=16) * 0.1 for _ in range(1 + k * 3)]
    rows += [rows[0] * 3, rows[0] * 3, rows[1]]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def test_vector_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 120)
    monkeypatch.setattr(vector_graph, "QUERIES", 90)
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0] * 15 + [None]), (9004, [1.0]), (9005, [1e-200] * 16), (9006, [1e200] * 16), (9007, [float("inf")] * 16), (9008, [])]
    rows = clouds(1) + odd
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, head string, n int, cluster int")
    got = {r.vec_id: r for r in vector_graph.links(df).collect()}
    want = linked(rows)
    assert len(got) == len(rows) and all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) > 0.98
    assert got[9005].component_id == got[9006].component_id == 9005 and got[0].audited_recall >= 0.9


def crowd_and_pairs(seed):
    """A third of the rows are near copies of one vector; most others are pairs."""
    rng = np.random.default_rng(seed)
    one = rng.normal(size=16)
    rows = [one + rng.normal(size=16) * 0.05 for _ in range(600)]
    for _ in range(600):
        v = rng.normal(size=16)
        rows += [v, v + rng.normal(size=16) * 0.1]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def test_small_groups_count_in_the_audit(spark):
    heads = spark.createDataFrame(crowd_and_pairs(5), "k long, v array<double>")
    found = spark.createDataFrame([(i, 599, 599) for i in range(600)], "k long, n long, m long")  # all of the crowd, no pair
    assert vector_graph._audit(heads, found, 0.9) < 0.1


def test_the_pass_after_failed_audits_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 300)
    monkeypatch.setattr(vector_graph, "CLUSTER", 150)
    monkeypatch.setattr(vector_graph, "REGION", 700)
    monkeypatch.setattr(vector_graph, "QUERIES", 400)
    monkeypatch.setattr(vector_graph, "RECALL", 1.1)  # no audit is good enough
    rows = crowd_and_pairs(6)
    got = {r.vec_id: r for r in vector_graph.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: (got[i].n_links, got[i].component_id) for i in got} == linked(rows)
    assert got[0].audited_recall == 1.0


def test_vectors_of_other_lengths_and_ids_with_several_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 30)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100, [1.0, 2.0, 2.0]), (101, [2.0, 4.0, 4.0]), (102, [1.0, 2.0, 2.1]), (103, [0.0, 0.0, 1.0])]
    rows += [(201, [1.0, 0.0]), (202, [1.0, 0.0]), (202, [0.0, 1.0]), (203, [0.1, 1.0])]
    got = [(r.vec_id, r.n_links, r.component_id) for r in vector_graph.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    assert sorted(x for x in got if x[0] >= 100) == [(100, 2, 100), (101, 2, 100), (102, 2, 100), (103, 0, 103), (201, 1, 201), (202, 1, 201), (202, 1, 201), (203, 1, 201)]


def test_regions_hold_what_their_size_says():
    places = vector_graph.Places({})
    sizes = {0: 10_000, 1: 20_000, 2: 100_000, 3: 5, 4: 23_990, 7: 1}
    places.settle(sizes)
    load = Counter()
    for c, n in sizes.items():
        for _, region in zip(range(n), places.shard(np.full(n, c), np.arange(n) * 977)[1]):
            assert region in places.regions(c)
            load[region] += 1
    assert max(load.values()) <= vector_graph.REGION * 1.1 and len(load) >= 7 and set(load) == set(range(max(load) + 1))


def test_vectors_empty_alone_and_repeated(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert vector_graph.links(df.limit(0)).count() == 0
    assert vector_graph.links(df).count() == 3
    (r,) = vector_graph.links(spark.createDataFrame([(7, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert (r.n_links, r.component_id) == (0, 7)


# registered queries and the pipeline
@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, ([r[c] for c in columns] for r in df.collect()))) == sorted(map(str, map(list, want.fetchall())))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_queries_have_a_row_for_each_input_row(spark, con, name):
    source = {"op5_style_tree": "pages", "op6_vector_graph": "embeddings"}.get(name, "documents")
    assert queries.QUERIES[name](spark, DATA).count() == con.execute(f"SELECT count(*) FROM {source}").fetchall()[0][0]


def test_pipeline_stages_act_on_what_the_last_one_kept(spark, tmp_path, con):
    pipeline = importlib.import_module("corpus_pipeline")
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        after = {r.doc_id: None if k == 4 else r.text for r in docs.collect()}
        assert set(after) <= set(before)
        seen.append((name, before, after))
    (_, all_docs, mild), (_, _, lines), (_, texts, single), (_, left, clean), (_, _, coded) = seen
    toxic = dict(con.execute("SELECT doc_id, toxic FROM labels").fetchall())
    judged = [i for i in all_docs if i in toxic]
    assert np.mean([(i in mild) != bool(toxic[i]) for i in judged]) > 0.85  # some seventy rows teach it here
    assert set(mild) == set(lines) and any(lines[i] != mild[i] for i in lines)
    groups_of = defaultdict(set)
    for i, c in by_brute_force(list(texts.items())).items():
        groups_of[c].add(i)
    assert set(single) == set(groups_of)
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    runs = {tuple(w[i : i + 8]) for _, t in items for w in [WORD.findall(t.lower())] for i in range(len(w) - 7)}
    leaky = {i for i, t in left.items() for w in [WORD.findall(t.lower())] if any(tuple(w[k : k + 8]) in runs for k in range(len(w) - 7))}
    assert set(clean) == set(left) - leaky and set(coded) == set(clean)
    assert pipeline.run(spark, DATA).count() == len(coded)


def odd_documents(spark, folder):
    """Null ids and texts, repeated rows, a very long text, and columns whose names the operators use themselves."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = " ".join(word() for _ in range(60))
    item = " ".join(f"item{k}" for k in range(12))
    rows = [(1, base), (2, base), (2, base), (3, base + " more"), (None, base), (None, None), (4, None), (5, ""), (6, "..."), (7, "..."), (8, f"see {item} there"), (None, f"and {item} too"), (9, "word " * 20_000)]
    rows += [(20 + i, f"a line that many documents share\n{word()} {word()} {word()} {word()} {word()} {i}") for i in range(6)] + [(None, "a line that many documents share\nmine")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, id string, bucket int, th long, t1 long, lines array<string>, share int, own int"
    df = spark.createDataFrame([(i, t, "x", "s", None if t is None else len(t), "i", 0, 1, 2, ["l"], 3, 4) for i, t in rows], kind)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 0, int(k % 5 == 0)) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    from tests.llm.test_text_ops import PIECES, dedup, hits, piece_table

    pipeline = importlib.import_module("corpus_pipeline")
    rows, d = odd_documents(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/in"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, stages = docs.columns, dict(pipeline.STAGES)
    of = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    mild = stages["toxicity"](spark, docs, d)
    assert mild.columns == columns and set(of(mild)) <= set(rows)
    lined = stages["line dedup"](spark, docs, d)
    want = Counter((i, None if rows[k][1] is None else t) for k, (i, _, _, t) in enumerate(dedup(rows)))
    assert lined.columns == columns and of(lined) == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lined.collect())
    single = stages["near-dedup"](spark, docs, d)
    first = by_brute_force(rows)
    assert single.columns == columns and of(single) == Counter((i, t) for i, t in rows if i is None or first[i] == i)
    clean = stages["decontamination"](spark, docs, d)
    items = [(1, " ".join(f"item{k}" for k in range(12)))]
    assert clean.columns == columns and of(clean) == Counter((i, t) for i, t in rows if not hits(t, items)[2])
    sp = piece_table._processor(PIECES)
    coded = Counter((r.doc_id, tuple(r.ids)) for r in stages["sentencepiece"](spark, docs, d).collect())
    assert coded == Counter((i, tuple(sp.encode(t or "") + [2])) for i, t in rows)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), d).count() == 0


def test_a_run_deletes_its_own_tables_only(spark, tmp_path):
    from marrow.llm.common import delete, gathered, saved

    kept = saved(spark.range(3), "kept")
    with gathered() as outer:
        a = saved(spark.range(4), "a")
        with gathered() as inner:
            saved(spark.range(5), "b")
    assert len(outer) == 2 and len(inner) == 1 and inner[0] in outer
    delete(spark, inner)
    assert kept.count() == 3 and a.count() == 4
