"""Near-duplicates of texts by BagMinHash: weighted-Jaccard signatures of the multisets of word shingles, banded
into buckets, with every candidate pair verified on the multisets themselves.

A signature register keeps the earliest point of Poisson processes over (shingle, weight): weights are cut at
0, 1, 2, 4, 8 ..., each range is a process with a rate of its width, seeded by the shingle and the range alone.  A
range that a count covers in part is split into halves again and again; all of a point's choices of a half are drawn at
once, as the binary digits of its position in the range, and the point counts if it lies below the count.
So two texts share a register's point with a probability equal to their weighted Jaccard similarity, and a long
text takes about as many points as a short one: processes stop at a time by which all registers are full (and go
on where one is not).

Texts with equal multisets form a class, whose smallest id stands for it.  Each bucket's members are compared with
its shortest text, and, where very many are then not all connected, with a few others.  At last all pairs of a bucket's
members in different components are held against each other by sketches of SKETCH bits, and those that
come near are verified.  First, of pairs whose sketches say that they are alike, a task makes one for each two
components that they would join, so a dense group takes about as many as it has members; then all that are left.
No bucket or group is capped, and pairs that would only repeat a connection are hardly made.
A pair at the threshold has sketches farther apart than DEVIATIONS allow with a probability of 3e-7.  Groups of copies
cost one comparison for each member, and the members of a leader are dealt over tasks.

With 25 bands of 5 registers a pair at a similarity of 0.8 shares a bucket with a probability of 0.99995.

Defined results: texts without words (null and empty alike, or marks only) are copies if they are equal and like nothing else.  Null ids are in no group
and are kept.  Rows that repeat an id are one document.  Of a bucket's texts of one length the smallest id leads.
Other columns are ignored by ``classes``, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marrow.llm.common import saved
from marrow.llm.groups import components, look_up, only_ids
from marrow.llm.piece_table import blocks
from marrow.llm.shingles import bags, jaccard, mix

BANDS, ROWS, THRESHOLD = 25, 5, 0.8
REGISTERS = BANDS * ROWS
#: A leader's members are dealt to shares of about so many, or to SHARES where their number isn't known.
PAIRS_IN_GROUP, SHARES = 64, 64
#: While buckets of more than BUCKET_SHARE members that are not all in one component have more rows than this in all,
#: and a round finds links, more leaders are drawn.
MANY_MEMBERS = 2_000_000
#: Bits of the sketches by which the remaining pairs of buckets are told apart, how many standard deviations apart
#: they may be, and members of a bucket in one task.
SKETCH, DEVIATIONS, BUCKET_SHARE = 2048, 5, 2000
#: Pairs whose sketches a task compares at a time, and points of all processes that it draws at a time.
PAIRS_AT_ONCE, POINTS_AT_ONCE = 20_000, 500_000
_UNIT = 2.0**-53


def _draw(seed: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th random number of each seed (k is of np.uint64)."""
    return mix(seed + k * np.uint64(0xA24BAED4963EE407))


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(float) + 0.5) * _UNIT


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """A row of 64-bit values, one for each register, for each text; zeros for a text without shingles."""
    out = np.zeros(n_docs * registers, np.uint64)
    if not len(doc):
        return out.reshape(n_docs, registers)
    ranges = [(doc, shingle, np.zeros(len(doc), np.int64), count)]
    low, j = 1, 1
    while (covered := count > low).any():  # range j is [low, 2 low)
        ranges.append((doc[covered], mix(shingle[covered] + np.uint64(j)), np.full(covered.sum(), low), count[covered]))
        low, j = 2 * low, j + 1
    d, seed, low_of, upto = (np.concatenate(x) for x in zip(*ranges, strict=True))
    rate = np.maximum(low_of, 1).astype(float)
    weight = np.bincount(doc, count, n_docs)
    horizon = np.zeros(n_docs)
    todo = weight > 0
    horizon[todo] = registers / weight[todo] * (np.log(registers) + 2)  # enough for seven texts of eight
    while todo.any():
        k = np.flatnonzero(todo[d])  # the processes that go on
        t = np.zeros(len(k))
        slots, times, names, r = [], [], [], 0
        while len(k):
            until = horizon[d[k]]
            # so many points of each at once: half of those to come in the mean
            ahead = int(np.clip(((until - t) * rate[k]).mean() / 2, 1, max(1, POINTS_AT_ONCE // len(k))))
            draws = np.arange(r, r + ahead, dtype=np.uint64) * np.uint64(3)
            after = -np.log(_uniform(_draw(seed[k][:, None], draws))) / rate[k][:, None]
            after[:, 0] += t
            t = np.cumsum(after, axis=1)
            alive = t <= until[:, None]
            row, column = np.nonzero(alive)
            of, draw, time = k[row], draws[column], t[alive]
            where = _draw(seed[of], draw + np.uint64(1))
            good = np.ones(len(of), bool)
            cut = np.flatnonzero(low_of[of])  # the first range, [0, 1), is covered as a whole
            at = _uniform(_draw(seed[of[cut]], draw[cut] + np.uint64(2))) * low_of[of[cut]]
            good[cut] = low_of[of[cut]] + at.astype(np.int64) < upto[of[cut]]
            slots.append((d[of] * registers + (where % np.uint64(registers)).astype(np.int64))[good])
            times.append(time[good])
            names.append(where[good])
            k, t = k[alive[:, -1]], t[alive[:, -1], -1]
            r += ahead
        slot, time, name = np.concatenate(slots), np.concatenate(times), np.concatenate(names)
        first = np.full(n_docs * registers, np.inf)
        np.minimum.at(first, slot, time)
        wins = time == first[slot]
        out[slot[wins]] = name[wins] | np.uint64(1)
        full = (first.reshape(n_docs, registers) < np.inf).all(1)
        todo &= ~full
        horizon[todo] *= 1.5
        out.reshape(n_docs, registers)[todo] = 0
    return out.reshape(n_docs, registers)


def _signed(docs: DataFrame) -> DataFrame:
    """(id, c1, c2, bands): c1 and c2 name the multiset; bands are empty for a text without words."""
    like, kind = to_arrow_type(docs.schema["id"].dataType), docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in blocks(batches, limit=500_000):
            doc, shingle, count = bags(texts)
            n = len(texts)
            sig = signatures(doc, shingle, count, n).reshape(n, BANDS, ROWS)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS))
            for k in range(ROWS):
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + sig[:, :, k])
            has = np.bincount(doc, minlength=n) > 0
            names = []
            for salt in (1, 2):
                x, c = mix(mix(shingle + np.uint64(salt)) + count.astype(np.uint64)), np.zeros(n, np.uint64)
                if len(x):
                    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                    c[doc[at]] = np.add.reduceat(x, at)
                for i in np.flatnonzero(~has):  # without words: named by the text itself
                    c[i] = int.from_bytes(blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8, salt=bytes([salt])).digest(), "little")
                names.append(pa.array(c.view(np.int64)))
            offsets = pa.array(np.r_[0, np.cumsum(has * BANDS)].astype(np.int32))
            bands = pa.ListArray.from_arrays(offsets, pa.array(h[has].ravel().view(np.int64)))
            size = pa.array(np.bincount(doc, count, n).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, like), *names, size, bands], names=["id", "c1", "c2", "n", "bands"])

    return docs.mapInArrow(run, f"id {kind}, c1 long, c2 long, n long, bands array<long>")


def _sketched(docs: DataFrame) -> DataFrame:
    """(id, sketch): one bit of each of SKETCH registers; bits differ with a probability of (1 - similarity) / 2."""
    like, kind = to_arrow_type(docs.schema["id"].dataType), docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in blocks(batches, limit=100_000):
            bits = (mix(signatures(*bags(texts), len(texts), SKETCH)) & np.uint64(1)).astype(np.uint8)
            sketches = [row.tobytes() for row in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, like), pa.array(sketches, pa.binary())], names=["id", "sketch"])

    return docs.mapInArrow(run, f"id {kind}, sketch binary")


def _with_sketches(docs: DataFrame, members: DataFrame, heads: DataFrame) -> DataFrame:
    """members (band, bucket, id, k) with sketches, all their buckets, and the number of shares that their bucket of k is dealt to."""
    texts = only_ids(docs, members.select("id").distinct(), "id").dropDuplicates(["id"])
    # dealt by work, since sketches take much of it and few bytes; by another hash, or adaptive execution joins partitions
    texts = texts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("id"))
    sketches = saved(_sketched(texts), "sketches").join(heads.select("id", "n", "bands"), "id")
    return saved(members.join(sketches, "id").withColumn("shares", F.ceil(F.col("k") / BUCKET_SHARE)), "sketched")


def _across(rows: DataFrame, threshold: float, deviations: float, sparse: bool = False) -> DataFrame:
    """The pairs (a, b) of a bucket's rows (bucket, id, own, shares, sketch) in different components whose sketches
    are near: pairs at the threshold differ in a share of (1 - threshold) / 2 of the bits, and those up to so many
    standard deviations beyond are made, each in the first bucket that has both.  If sparse, a task makes only one, the
    nearest it sees, for each two components that they would join.  The members of a large bucket are dealt over
    tasks, where those of a share meet each other and those of later shares."""
    like, kind = to_arrow_type(rows.schema["id"].dataType), rows.schema["id"].dataType.simpleString()
    q = (1 - threshold) / 2
    most = int(SKETCH * q + deviations * (SKETCH * q * (1 - q)) ** 0.5)
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")))
    dealt = dealt.withColumn("into", F.explode(F.sequence(F.lit(0).cast("long"), "share"))).withColumn("later", F.col("share") != F.col("into"))
    # much work and few bytes: by a fixed number, or adaptive execution joins partitions
    dealt = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "into").sortWithinPartitions("bucket", "into", "later", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _near(batches, threshold, most, sparse):
            yield pa.RecordBatch.from_arrays([pa.array(a, like), pa.array(b, like)], names=["a", "b"])

    found = dealt.select("bucket", "into", "later", "id", "own", "n", "band", "bands", "sketch").mapInArrow(run, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _near(batches: Iterator[pa.RecordBatch], threshold: float, most: int, sparse: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of one task of ``_across``, whose rows are sorted.  Of a share that may go on in the next batch only
    the rows that aren't ``later`` are kept, about BUCKET_SHARE of them."""
    number: dict = {}  # of each component
    root = np.zeros(0, np.int64)  # of each number, the least of those that pairs have joined it to
    kept, rows = 0, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        new = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in ("bucket", "into", "later", "id", "n", "band")}
        new["own"] = np.array([number.setdefault(x, len(number)) for x in batch.column("own").to_pylist()], np.int64)
        new["bands"] = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        new["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
        root = np.r_[root, np.arange(len(root), len(number))]
        rows = {x: np.concatenate([rows[x], new[x]]) for x in new} if kept else new
        bucket, into, later, ids, n, band, own, bands, sketch = rows.values()
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (into[1:] != into[:-1])])
        ends = np.repeat(np.r_[starts[1:], len(ids)], np.diff(np.r_[starts, len(ids)]))
        first = np.maximum(np.arange(len(ids)) + 1, kept)  # pairs of two kept rows are made
        count = np.where(later, 0, ends - first)
        done = np.cumsum(count)
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(done, done[at] - count[at] + PAIRS_AT_ONCE, "right")))
            c = count[at:to]
            i = np.repeat(np.arange(at, to), c)
            j = np.arange(len(i)) + np.repeat(first[at:to] - (np.cumsum(c) - c), c)
            at = to
            # of one component, or of sizes that can't be so similar
            hold = (root[own[i]] != root[own[j]]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
            i, j = i[hold], j[hold]
            differ = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64)
            hold = differ <= most
            i, j, differ = i[hold], j[hold], differ[hold]
            if sparse and len(i):
                chosen = _joining(root, root[own[i]], root[own[j]], differ)
                i, j = i[chosen], j[chosen]
            elif len(i):  # an earlier band makes some of the pairs
                hold = ~((bands[i] == bands[j]) & (np.arange(BANDS) < band[i][:, None])).any(1)
                i, j = i[hold], j[hold]
            if len(i):
                yield ids[i], ids[j]
        last = np.flatnonzero(~later[starts[-1] :].astype(bool)) + starts[-1]
        rows, kept = {x: v[last] for x, v in rows.items()}, len(last)


def _joining(root: np.ndarray, a: np.ndarray, b: np.ndarray, differ: np.ndarray) -> list[int]:
    """Which of the pairs (a, b) of roots, the nearest first, join what isn't joined yet; they are joined in ``root``."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((differ, hi, lo))
    nearest = order[np.r_[True, (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)]]
    chosen = []
    for k in nearest[np.argsort(differ[nearest], kind="stable")]:
        x, y = lo[k], hi[k]
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            chosen.append(k)
    while not np.array_equal(up := root[root], root):
        root[:] = up
    return chosen


def verified(docs: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose texts are alike enough, with their similarity.  docs: id, text.  pairs: a, b, and k if
    the number of pairs of each a is about known."""
    if "k" in pairs.columns:  # about so many members has the leader a
        pairs = saved(pairs.filter("a <> b").groupBy("a", "b").agg(F.max("k").alias("k")), "pairs")
    else:
        pairs = saved(pairs.filter("a <> b").distinct(), "pairs").withColumn("k", F.lit(PAIRS_IN_GROUP * SHARES))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / PAIRS_IN_GROUP)).alias("share"))
    texts = only_ids(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "id").dropDuplicates(["id"])
    kind = docs.schema["id"].dataType.simpleString()
    rows = dealt.join(texts, F.col("b") == F.col("id")).select("a", "share", "b", "text")
    rows = rows.union(dealt.select("a", "share").distinct().join(texts, F.col("a") == F.col("id")).select("a", "share", F.lit(None).cast(kind), "text"))
    rows = rows.repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    like = to_arrow_type(docs.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, bag = None, None
        for batch in (x.slice(at, 500) for x in batches for at in range(0, len(x), 500)):
            found = ([], [], [])
            firsts, shares, seconds, texts = (c.to_pylist() for c in batch.columns)
            doc, shingle, count = bags([t or "" for t in texts])
            bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
            for k, (a, share, b) in enumerate(zip(firsts, shares, seconds, strict=True)):
                own = shingle[bounds[k] : bounds[k + 1]], count[bounds[k] : bounds[k + 1]]
                if b is None:
                    head, bag = (a, share), own
                elif head == (a, share) and (x := jaccard(bag, own)) >= threshold:
                    for column, v in zip(found, (a, b, x), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], like), pa.array(found[1], like), pa.array(found[2], pa.float64())], names=["a", "b", "similarity"])

    return saved(rows.mapInArrow(run, f"a {kind}, b {kind}, similarity double"), "links")


def _mixed(placed: DataFrame) -> DataFrame:
    """The members (bucket, id, own) of buckets that have more than one component, with the number k of the bucket's."""
    placed = saved(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("k")).filter("lo < hi")
    return saved(look_up(placed, mixed, ["bucket"], "k", "k").filter("k is not null"), "mixed")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: id, class_id (the smallest id of its group) and copy_of (the smallest id with an equal multiset of shingles)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = saved(_signed(texts), "signatures")
    named = signed.filter(F.col("id").isNotNull())
    wordy = named.filter(F.size("bands") > 0)
    same = saved(named.groupBy("c1", "c2").agg(F.min("id").alias("copy_of"), F.count("*").alias("n")), "copies")
    # one row for each class: its members have equal bands, so any row's will do
    heads = wordy.groupBy("c1", "c2").agg(F.min_by("bands", "id").alias("bands"), F.min("id").alias("id"), F.first("n").alias("n"))
    in_buckets = heads.select("id", "n", F.posexplode("bands").alias("band", "bucket"))
    first = F.min(F.struct("n", "id"))["id"]
    leaders = in_buckets.groupBy("bucket").agg(first.alias("leader"), F.count("*").alias("k")).filter("k > 1")
    leaders = saved(leaders.withColumn("led", F.struct("leader", "k")), "leaders")
    members = look_up(in_buckets, leaders, ["bucket"], "led", "k").filter(F.col("led").isNotNull())
    members = saved(members.select("band", "bucket", "id", "led.leader", "led.k"), "members")
    links = verified(texts, members.select(F.col("leader").alias("a"), F.col("id").alias("b"), "k"), threshold).select("a", "b")
    names = saved(components(links), "components")
    own = lambda df: df.join(names, "id", "left").withColumn("own", F.coalesce("component", "id")).drop("component")

    members = _mixed(own(members.select("band", "bucket", "id")))
    r = 0
    large = lambda df: df.filter(F.col("k") > BUCKET_SHARE).drop("k")
    while large(members).count() > MANY_MEMBERS:  # each leader takes one comparison for each member, and connects what is dense
        r += 1
        counted = large(members).groupBy("bucket", "own").agg(F.count("*").alias("k"))
        top = counted.groupBy("bucket").agg(F.max_by("own", F.struct("k", "own")).alias("top"), F.sum("k").alias("k"))
        strays = look_up(large(members), top, ["bucket"], "top", "k").filter("own <> top")  # the leader is drawn from outside of the bucket's commonest component
        drawn = strays.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("h"), "id", "own")).alias("drawn"))
        drawn = drawn.join(top.select("bucket", "k"), "bucket").withColumn("drawn", F.col("drawn").withField("k", F.col("k")))
        drawn = saved(drawn, "drawn")
        pairs = look_up(large(members), drawn, ["bucket"], "drawn", "k").filter("own <> drawn.own")
        fresh = verified(texts, pairs.select(F.col("drawn.id").alias("a"), F.col("id").alias("b"), "drawn.k"), threshold).select("a", "b")
        if not fresh.limit(1).count():
            break
        links = links.union(fresh)
        names = saved(components(links), "components")
        members = _mixed(own(members.drop("own", "k")))

    # what is left: all pairs of a bucket in different components, of which near sketches alone are made; the
    # nearer ones come first, since what they connect need not be made again; sizes alone rule many out
    sketched = _with_sketches(texts, members.drop("own"), heads)
    for deviations, sparse in ((-2, True), (0, True), (DEVIATIONS / 2, False), (DEVIATIONS, False)):
        fresh = verified(texts, _across(own(sketched), threshold, deviations, sparse), threshold).select("a", "b")
        if fresh.limit(1).count():
            links = links.union(fresh)
            names = saved(components(links), "components")

    full = same.join(names.withColumnRenamed("id", "copy_of"), "copy_of", "left").withColumn("class", F.struct(F.coalesce("component", "copy_of").alias("class_id"), "copy_of"))
    out = look_up(signed.select("id", "c1", "c2"), full, ["c1", "c2"], "class", "n")
    return out.select(F.col("id").alias(id_col), *[F.when(F.col("id").isNotNull(), F.coalesce(f"class.{c}", "id")).alias(c) for c in ("class_id", "copy_of")])
