"""Near-duplicate classes by BagMinHash signatures of five-word shingles.

Signature. A text is the multiset of its shingles (a text of one to four words has one shingle, all of it). Weights are
discretised to whole numbers and cut into the ranges [0,1), [1,2), [2,4), [4,8), ... Each shingle has one Poisson
process for each range, with the range's width as its rate: a point has a time, one of the m places of the signature
and a weight level within the range. A point counts if its level lies below the shingle's weight. A place holds the
earliest time of its points, so two texts agree in a place with the probability of their weighted Jaccard similarity.
Points are drawn in the order of time, for all shingles of many texts at once, until none can come before the latest
place of its text.

Classes. Texts with one multiset form one node. Nodes that agree in all rows of a band are candidates. First each is
compared with the leader of its bucket, the node that meets the most others; verified links are joined to components.
Then all nodes that met one leader but lie in different components are compared if what each shares with the leader
leaves it possible that they are similar. A link needs a multiset Jaccard similarity of at least `similarity`, computed
exactly. So every bucket is settled, without pairs within what is already one class and without a cap.

Hot leaders. What meets by leader (its bucket's members, their sets) is dealt to one task for each HOT_MEMBERS of them,
with the leader's part sent to each, so a bucket may hold any share of all rows.

Defined cases. A null or empty text, or one without a word, is in a class of its own. A class's id is the least doc_id
in it; classes of rows without an id, or of unlike texts that share one, have the same id and differ in their root. Rows
that repeat are copies. Texts of any length count whole; only the signatures of many short ones are computed together.
An empty table has no classes. Columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choralis.llm.common import WORD, chunks, map_arrow, quoted, row_key, written

SHINGLE = 5
ROWS, BANDS = 5, 25
PLACES = ROWS * BANDS
#: Row keys up to this number (8 bytes each) are sent to the workers; more are joined by a shuffle.
SENT_KEYS = 2_000_000
#: Members of a leader that one task compares with it.
HOT_MEMBERS = 1024
WORDS = re.compile(WORD)
_hashes: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_hashes) > 400_000:
        _hashes.clear()
    get, out = _hashes.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _hashes[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def bag(text: str, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The text's shingles, as sorted hashes, and their counts."""
    words = WORDS.findall(text)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = _word_hashes(words)
    n = min(n, len(h))
    run = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        run = run * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    run = np.sort(_mix(run))
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    return run[first], np.diff(np.r_[first, len(run)])


def members(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The multiset as a set: the k-th copy of a shingle is a member of its own."""
    if not len(counts) or counts.max() == 1:
        return shingles
    at = np.repeat(np.arange(len(counts)), counts)
    k = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.where(k == 0, shingles[at], _mix(shingles[at] + k.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], places: int = PLACES) -> np.ndarray:
    """BagMinHash: the earliest time in each place, one row for each bag."""
    sig = np.full(len(bags) * places, np.inf)
    if not bags:
        return sig.reshape(0, places)
    doc = np.repeat(np.arange(len(bags)), [len(s) for s, _ in bags])
    shingle = np.concatenate([s for s, _ in bags]) if len(doc) else np.zeros(0, np.uint64)
    weight = np.concatenate([c for _, c in bags]) if len(doc) else np.zeros(0, np.int64)
    parts = [(doc, shingle, weight, 0, 1)]
    low, level = 1, 1
    while (more := weight > low).any():
        parts.append((doc[more], shingle[more], weight[more], low, low))
        low, level = low * 2, level + 1
    doc = np.concatenate([p[0] for p in parts])
    seed = np.concatenate([_mix(p[1] + np.array([k], np.uint64) * np.uint64(0x632BE59BD9B4E019)) for k, p in enumerate(parts)])
    start = np.concatenate([np.full(len(p[0]), p[3]) for p in parts])
    width = np.concatenate([np.full(len(p[0]), p[4]) for p in parts])
    weight = np.concatenate([p[2] for p in parts])
    time, drawn = np.zeros(len(doc)), 0
    while len(doc):
        step = int(np.clip(200_000 // len(doc), 1, 32))
        k = np.arange(drawn + 1, drawn + step + 1, dtype=np.uint64)
        drawn += step
        r = _mix(seed[:, None] + k[None, :] * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / width[:, None]
        times = np.cumsum(np.c_[time, gap], axis=1)[:, 1:]  # gap after gap: sums don't depend on how many are drawn at once
        r = _mix(r)
        place = (r >> np.uint64(40)).astype(np.int64) % places
        at = doc[:, None] * places + place
        counts = np.broadcast_to((width == 1)[:, None], at.shape)
        if not counts.all():
            counts = start[:, None] + (r & np.uint64(0xFFFFFF)).astype(np.int64) % width[:, None] < weight[:, None]
        np.minimum.at(sig, at[counts], times[counts])
        time = times[:, -1]
        latest = sig.reshape(-1, places).max(axis=1)
        on = time < latest[doc]
        doc, seed, start, width, weight, time = doc[on], seed[on], start[on], width[on], weight[on], time[on]
    return sig.reshape(-1, places)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), sig.shape[1] // rows, rows)
    key = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2])
    for k in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return key.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, row, node (null without a word) and the keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            bags = [bag(t) for t in texts]
            full = [i for i, b in enumerate(bags) if len(b[0])]
            nodes: list[int | None] = [None] * len(bags)
            keys: list[np.ndarray | None] = [None] * len(bags)
            for i, k in zip(full, band_keys(signatures([bags[i] for i in full])), strict=True):
                nodes[i] = xxhash.xxh3_64_intdigest(bags[i][0].tobytes() + bags[i][1].tobytes()) - 2**63
                keys[i] = k
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "row": batch.column(1), "node": pa.array(nodes, pa.int64()), "bands": pa.array(keys, pa.list_(pa.int64()))})
        _hashes.clear()

    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row"), "text")
    return map_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, node long, bands array<long>")


def _members_of(docs: DataFrame, reps: DataFrame, sent_keys: int = SENT_KEYS) -> DataFrame:
    """node and its set of members, for the rows (row, node) of reps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            sets = [members(*bag(t)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "set": pa.array(sets, pa.list_(pa.int64()))})

    rows = docs.select(row_key("doc_id", "text").alias("row"), "text")
    if reps.count() <= sent_keys:
        wanted = np.sort(reps.select("row").toArrow()["row"].to_numpy())  # 8 bytes a key in the driver too, and no row objects
        held = docs.sparkSession.sparkContext.broadcast(wanted)

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = held.value
            done = np.zeros(len(keys), bool)
            for batch in batches if len(keys) else ():
                row = batch.column(0).to_numpy()
                at = np.minimum(np.searchsorted(keys, row), len(keys) - 1)
                hit = np.flatnonzero((keys[at] == row) & ~done[at])
                hit = hit[np.unique(at[hit], return_index=True)[1]]  # of rows that repeat, the first
                done[at[hit]] = True
                yield from run(iter([batch.take(pa.array(np.sort(hit)))]))

        sets = map_arrow(rows, pick, "row long, set array<long>")
    else:
        sets = map_arrow(rows.join(reps.select("row"), "row", "left_semi"), run, "row long, set array<long>")
    return reps.select("row", "node").join(sets, "row").select("node", "set").dropDuplicates(["node"])


def _hot(pairs: DataFrame) -> DataFrame:
    """a and parts, of the leaders that meet more than HOT_MEMBERS nodes; few beside the pairs."""
    return pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HOT_MEMBERS).select("a", F.ceil(F.col("n") / HOT_MEMBERS).alias("parts"))


def _meet(rows: DataFrame, leaders: DataFrame, hot: DataFrame) -> DataFrame:
    """rows (a, b and others) joined with the one row of leaders (a and others), if there is one; a hot leader's rows in
    several tasks."""
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))
    rows = rows.join(hot, "a", "left").withColumn("part", part).drop("parts")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))
    leaders = leaders.join(hot, "a", "left").withColumn("part", each).drop("parts")
    return rows.join(leaders, ["a", "part"]).drop("part")


def _compared(pairs: DataFrame, sets: DataFrame, hot: DataFrame) -> DataFrame:
    """a, b, na, nb (sizes of their sets), met (of what they share) and extra (members of b that a lacks)."""
    x = sets.join(pairs.select(F.col("a").alias("node")).distinct(), "node").select(F.col("node").alias("a"), F.col("set").alias("sa"))
    y = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = _meet(pairs.join(y, "b"), x, hot).withColumn("extra", F.array_except("sb", "sa"))
    return both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), (F.size("sb") - F.size("extra")).alias("met"), "extra")


def _alike(met, n, similarity: float):
    """Whether `met` of `n` members in both sets together make them similar enough."""
    return met * (1 + similarity) >= similarity * n - 1e-9


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    return _compared(pairs, sets, written(_hot(pairs), "near-hot")).where(_alike(F.col("met"), F.col("na") + F.col("nb"), similarity)).select("a", "b")


def _still_open(tested: DataFrame, roots: DataFrame, sets: DataFrame, hot: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes that met one leader, lie in different components and may yet be similar enough.

    What two nodes x, y share is either in their leader's set or extra to both. So they are similar enough only if they
    share enough extra members, or if the smaller of their overlaps with the leader alone is large enough for their sizes,
    which bounds the size of each by the other's. The first is a join on those extra members that more than one component
    has, of each node only so many of the rarest that two nodes which share enough must share one of these; the second
    is a join on bins of size.
    """
    at = roots.withColumnRenamed("node", "b")
    placed = tested.join(at, "b", "left").withColumn("root", F.coalesce("root", "b"))
    own = tested.select("a").distinct().join(roots.withColumnRenamed("node", "a"), "a", "left").select("a", F.coalesce("root", "a").alias("ra"))
    mixed = placed.join(own, "a").groupBy("a").agg(F.min(F.least("root", "ra")).alias("x"), F.max(F.greatest("root", "ra")).alias("y")).where("x < y").select("a")
    open_ = written(_meet(placed, mixed, hot).select("a", "b", "nb", "met", "root"), "near-open")
    extra = _compared(open_.select("a", "b"), sets, hot).select("a", "b", F.explode("extra").alias("m")).join(open_, ["a", "b"])
    extra = written(extra.select("a", "m", "b", "root", "nb", "met"), "near-extra")
    told = extra.groupBy("a", "m").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("often")).where("x < y").select("a", "m", "often")
    least = open_.groupBy("a").agg(F.min("nb").alias("least"))
    extra = _meet(extra.join(told, ["a", "m"]), least, hot)
    # what a partner must share at least in extra members, as no partner is smaller than the least of them all
    size = F.col("nb") + F.greatest(F.col("nb") * similarity, F.col("least"))
    need = F.greatest(F.lit(1), F.ceil(size * similarity / (1 + similarity) - F.col("met") - 1e-6))
    rarest = F.row_number().over(Window.partitionBy("a", "b").orderBy("often", "m"))
    extra = extra.withColumn("rank", rarest).withColumn("own", F.count("*").over(Window.partitionBy("a", "b")))
    extra = extra.where(F.col("rank") <= F.col("own") - need + 1)
    x = extra.select("a", "m", F.col("b").alias("x"), F.col("root").alias("rx"), F.col("nb").alias("nx"), F.col("met").alias("mx"))
    y = extra.select("a", "m", F.col("b").alias("y"), F.col("root").alias("ry"), F.col("nb").alias("ny"), F.col("met").alias("my"))
    most = F.least("mx", "my") + F.least(F.col("nx") - F.col("mx"), F.col("ny") - F.col("my"))
    sharing = x.join(y, ["a", "m"]).where("rx < ry").where(_alike(most, F.col("nx") + F.col("ny"), similarity)).select("x", "y")
    within = open_.where(F.col("met") >= similarity * F.col("nb") - 1e-9)
    step = 1.03
    low = F.floor(F.log(step, F.col("nb") * similarity - 1e-6))
    high = F.floor(F.log(step, F.col("met") * (1 + 1 / similarity) - F.col("nb") + 1e-6))
    x = within.select("a", F.col("b").alias("x"), F.col("root").alias("rx"), F.col("nb").alias("nx"), F.col("met").alias("mx"), F.explode(F.sequence(low, F.greatest(high, low))).alias("bin"))
    y = within.select("a", F.col("b").alias("y"), F.col("root").alias("ry"), F.col("nb").alias("ny"), F.col("met").alias("my"), F.floor(F.log(step, F.col("nb").cast("double"))).alias("bin"))
    close = x.join(y, ["a", "bin"]).where("rx < ry").where(_alike(F.least("mx", "my"), F.col("nx") + F.col("ny"), similarity)).select("x", "y")
    return sharing.unionByName(close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root, the least node that it is connected with; edges: a, b. Alternating large and small stars."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        sym = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = written(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_classes(docs: DataFrame, similarity: float = 0.8, sent_keys: int = SENT_KEYS) -> DataFrame:
    """doc_id, row (key of doc_id and text), node, root and class_id, one row for each of docs (doc_id, text).

    root is the least node of the class (null without a word) and, unlike class_id, tells any two classes apart."""
    docs = docs.select("doc_id", "text")
    sketched = written(sketch(docs), "near-sketch")
    one = sketched.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "row", "bands")).alias("r"))
    one = one.select("node", "r.row", F.explode("r.bands").alias("band"))
    shared = one.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    near = written(one.join(shared.hint("merge"), "band").select("band", "node", "row", "n"), "near-candidates")
    reps = near.groupBy("node", "row").agg(F.sum("n").alias("meets"))
    sets = written(_members_of(docs, reps, sent_keys), "near-sets")
    ranked = near.select("band", "node").join(reps.select("node", "meets"), "node")
    leaders = ranked.groupBy("band").agg(F.max_by("node", F.struct("meets", -F.col("node"))).alias("leader"))
    first = near.select("band", "node").join(leaders, "band").where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = written(first, "near-first")
    hot = written(_hot(first), "near-hot")
    tested = written(_compared(first, sets, hot).drop("extra"), "near-tested")
    links = tested.where(_alike(F.col("met"), F.col("na") + F.col("nb"), similarity)).select("a", "b")
    roots = components(links)
    more = written(_still_open(tested, roots, sets, hot, similarity), "near-rest")
    more = written(_linked(more, sets, similarity), "near-more")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    nodes = sketched.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = rooted.groupBy("root").agg(F.min("least_id").alias("class_id"))
    named = written(rooted.join(classes, "root").select("node", "root", "class_id"), "near-classes")
    known = sketched.select("doc_id", "row", "node").where("node is not null").join(named, "node")
    alone = sketched.where("node is null").select("node", "doc_id", "row", F.col("node").alias("root"), F.col("doc_id").alias("class_id"))
    return known.unionByName(alone).select("doc_id", "row", "node", "root", "class_id")


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs without all but one document of each class: the one with the least doc_id, then row key; texts without a
    word all stay, of rows that agree in doc_id and text one stays."""
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("whole"), row_key("doc_id", "text").alias("row"))
    found = near_classes(docs, similarity)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m")
    first = found.where("node is not null").groupBy("root").agg(least).select("m.row")
    kept = first.unionByName(found.where("node is null").select("row")).distinct()
    often = found.groupBy("row").agg(F.count("*").alias("n"))
    kept = written(kept.join(often, "row"), "near-kept")
    # texts meet by their keys at any size, for a broadcast would only do where few are kept
    plain = whole.join(kept.where("n = 1").select("row").hint("merge"), "row", "left_semi")
    # of rows that repeat, each task passes one on
    twins = whole.join(kept.where("n > 1").select("row"), "row", "left_semi").groupBy("row").agg(F.first("whole").alias("whole"))
    return plain.select("whole.*").unionByName(twins.select("whole.*"))
