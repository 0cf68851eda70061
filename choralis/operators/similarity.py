"""TF-IDF similarity of the replies of a conversation.

A conversation has at most 400 replies, so the number of pairs is linear in the number of conversations. Longer ones are
compared in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choralis.config import Config
from choralis.functions.exact import floor_seconds, round3
from choralis.functions.settle import kept
from choralis.functions.text import lexical_diversity, normalised, tokens

#: Any function from tokenised replies to pairs (conv_id, i, j, sim) with i < j; a missing pair has similarity 0.
SimilarityModel = Callable[[DataFrame], DataFrame]


def tokenised(replies: DataFrame) -> DataFrame:
    """replies with norm, words, token_count and lex (rounded)."""
    t = replies.withColumn("norm", normalised(F.col("text"))).withColumn("words", tokens(F.col("norm")))
    return t.withColumn("token_count", F.size("words")).withColumn("lex", round3(lexical_diversity(F.col("words"))))


def measured(texts: DataFrame) -> DataFrame:
    """texts with norm, token_count, lex and digest, by which equal texts meet."""
    return tokenised(texts).withColumn("digest", F.sha2("norm", 256)).drop("words")


def document_frequency(words: DataFrame) -> DataFrame:
    """conv_id, term, df."""
    terms = words.select("conv_id", F.explode(F.array_distinct("words")).alias("term"))
    return terms.groupBy("conv_id", "term").agg(F.count("*").alias("df"))


def _sized(words: DataFrame) -> DataFrame:
    """conv_id, pos, words, n: replies dealt by conversation, with its number of replies. All counts, windows and groups
    below that have conv_id in their key follow this one shuffle."""
    n = words.groupBy("conv_id").agg(F.count("*").alias("n"))
    return words.select("conv_id", "pos", "words").repartition("conv_id").join(n, "conv_id")


def _weighted(sized: DataFrame, *also: str) -> DataFrame:
    """conv_id, pos, term, w, df, n of _sized replies, and what else they have that is named."""
    terms = sized.select("conv_id", "n", "pos", *also, F.explode("words").alias("term"))
    tf = terms.groupBy("conv_id", "n", "pos", "term").agg(F.count("*").alias("tf"), *[F.max(c).alias(c) for c in also])
    raw = tf.withColumn("df", F.count("*").over(Window.partitionBy("conv_id", "term")))
    raw = raw.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("conv_id", "pos")))
    return raw.select("conv_id", "pos", "term", (F.col("w") / length).alias("w"), "df", "n", *also)


def term_weights(words: DataFrame) -> DataFrame:
    """conv_id, pos, term, w, df: tf * (ln((1 + n) / (1 + df)) + 1), of unit length for each reply.

    df and n are windows over rows that are dealt by conversation once, before words become rows.
    """
    return _weighted(_sized(words)).drop("n")


#: Replies of a conversation that are compared in one group; longer conversations take a group for each two blocks of so many.
BLOCK = 400
#: Terms that a group's matrix holds at a time.
TERMS = 2048
ROWS = "conv_id string, i int, js array<int>, sims array<double>, best double, best_pos int, own double"


def _rows_of(conv_id: str, pos: np.ndarray, of: pa.Table, at: np.ndarray, who: np.ndarray, term: np.ndarray, w: np.ndarray, mixed: bool, least: float | None) -> pa.Table:
    """A row for each reply of the group: those after it that share a term, in order, with their similarities, of which
    `least` leaves out the smaller ones that nobody asked for; the greatest similarity to any other of the group, with the
    first reply that has it; and the greatest to one of the same account. Row k of `of` tells of the reply at[k]; its term
    `term` has the weight w, by its order in `pos` (who)."""
    part, account, known = np.zeros(len(pos), dtype=np.int64), np.zeros(len(pos), dtype=np.int64), np.zeros(len(pos), dtype=bool)
    part[at] = of["part"].to_numpy()
    account[at] = pc.fill_null(of["account"], 0).to_numpy()
    known[at] = pc.is_valid(of["account"]).to_numpy()
    _, term = np.unique(term, return_inverse=True)
    order = np.argsort(term, kind="stable")
    who, term, w = who[order], term[order], w[order]
    dots = np.zeros((len(pos), len(pos)))
    for first in range(0, int(term[-1]) + 1 if len(term) else 0, TERMS):
        a, b = np.searchsorted(term, [first, first + TERMS])
        m = np.zeros((len(pos), TERMS))
        m[who[a:b], term[a:b] - first] = w[a:b]
        dots += m @ m.T
    if mixed:  # within a block they meet in the block's own group
        dots[part[:, None] == part] = 0
    np.fill_diagonal(dots, 0)
    met = dots > 0
    sims = np.round(np.clip(dots, 0, 1), 12)
    best = np.where(met, sims, -1).argmax(axis=1)
    own = np.where(met & (account[:, None] == account) & known[:, None] & known, sims, -1).max(axis=1)
    after = np.triu(met)
    if least is not None:
        asked = np.zeros(met.shape, dtype=bool)
        for k, others in zip(at, of["asked"].to_pylist(), strict=True):
            if others:
                asked[k] |= np.isin(pos, others)
        after &= (sims >= least) | asked | asked.T
    ends = np.concatenate([[0], np.cumsum(after.sum(axis=1))]).astype(np.int32)
    some = np.flatnonzero(met.any(axis=1))
    js = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.broadcast_to(pos.astype(np.int32), after.shape)[after]))
    values = pa.ListArray.from_arrays(pa.array(ends), pa.array(sims[after]))
    told = [pa.array([conv_id] * len(some), pa.string()), pa.array(pos[some].astype(np.int32)), js.take(pa.array(some)), values.take(pa.array(some))]
    told += [pa.array(sims[some, best[some]]), pa.array(pos[best[some]].astype(np.int32)), pa.array(own[some], mask=own[some] < 0)]
    return pa.Table.from_arrays(told, names=["conv_id", "i", "js", "sims", "best", "best_pos", "own"])


def _of_block(least: float | None) -> Callable[[tuple, pa.Table], pa.Table]:
    """The rows of two blocks of a long conversation, from the weights of its terms."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pos, who = np.unique(rows["pos"].to_numpy(), return_inverse=True)
        return _rows_of(key[0].as_py(), pos, rows, who, who, rows["t"].to_numpy(), rows["w"].to_numpy(), key[1].as_py() != key[2].as_py(), least)

    return run


def _of_conversation(least: float | None) -> Callable[[tuple, pa.Table], pa.Table]:
    """The rows of a whole conversation, from the hashes of its replies' words: the weights of term_weights by numpy."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        n, words = rows["n"][0].as_py(), rows["words"]
        pos, at = np.unique(rows["pos"].to_numpy(), return_inverse=True)
        who = at[np.repeat(np.arange(len(at)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())]
        terms, term = np.unique(pc.list_flatten(words).to_numpy(), return_inverse=True)
        held, tf = np.unique(who * max(1, len(terms)) + term, return_counts=True)
        who, term = np.divmod(held, max(1, len(terms)))
        df = np.bincount(term, minlength=len(terms))[term]
        w = tf * (np.log((1 + n) / (1 + df)) + 1)
        w = w / np.sqrt(np.bincount(who, w * w, len(pos)))[who]
        met = df > 1
        return _rows_of(key[-1].as_py(), pos, rows, at, who[met], term[met], w[met], False, least)

    return run


def tfidf_rows(words: DataFrame, least: float | None = None, asked: Column | None = None, by: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """conv_id, i, js, sims, best, best_pos, own: the pairs of tfidf_pairs, those of a first reply in one row, or in some
    rows where its conversation is longer than BLOCK. own: the greatest similarity to another reply of the same account.

    Given least, js only holds pairs of at least that, and those that `asked`, a list of positions for each reply, names
    (with it for the later of the two, too). by: columns that the conversation determines, conv_id last; where rows lie by
    some of them already, no reply moves. Else texts move once, as hashes, dealt by conversation. What two replies add up
    to for each term that they share never moves, and words never become rows but in conversations longer than BLOCK,
    which are dealt again, each two blocks of theirs to a group of at most about 2 * BLOCK replies.
    """
    account = F.when(F.col("account_id").isNotNull(), F.xxhash64("account_id")) if "account_id" in words.columns else F.lit(None).cast("long")
    hashed = F.transform("words", lambda x: F.xxhash64(x))
    named = (F.lit(None) if asked is None else asked).cast("array<int>")
    n = F.count("*").over(Window.partitionBy(*by))
    given = words.withColumn("n", n).where("pos is not null")
    sized = given.select(*by, "pos", "n", hashed.alias("words"), account.alias("account"), named.alias("asked"), F.lit(0).cast("long").alias("part"))
    whole = sized.where(F.col("n") <= BLOCK).groupBy(*by).applyInArrow(_of_conversation(least), ROWS)

    long = sized.where(F.col("n") > BLOCK)
    long = long if by == ("conv_id",) else long.repartition("conv_id")
    w = _weighted(long, "account", "asked").where("df > 1").withColumnRenamed("term", "t").withColumn("conv_id", F.col("conv_id").cast("string"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    w = w.withColumn("part", F.pmod(F.xxhash64("pos"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = w.select("conv_id", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "pos", "part", "account", "asked", "t", "w").repartition("conv_id", "a", "b")
    return whole.unionByName(dealt.groupBy("conv_id", "a", "b").applyInArrow(_of_block(least), ROWS))


def pairs_of(rows: DataFrame, least: float | None = None) -> DataFrame:
    """conv_id, i, j, sim of tfidf_rows; those with a similarity of at least `least`, if given."""
    each = F.arrays_zip(F.col("js").alias("j"), F.col("sims").alias("sim"))
    each = each if least is None else F.filter(each, lambda x: x["sim"] >= least)
    return rows.select("conv_id", "i", F.inline(each).alias("j", "sim"))


def tfidf_pairs(words: DataFrame) -> DataFrame:
    """Cosine of all pairs that share a term.

    Rounded to 12 digits, so that the order of summation doesn't decide between equal texts.
    """
    return pairs_of(tfidf_rows(words))


#: What sums may lose to the order of adding.
SLACK = 1e-9


def _no_less(x: Column) -> Column:
    """x as a float that is no smaller, for bounds."""
    return (x * (1 + 1e-6)).cast("float")


def ordered_weights(words: DataFrame) -> DataFrame:
    """conv_id, pos, terms: a row for each reply, with those of its terms that another of its conversation has, from the
    commonest to the rarest. A term has t (hashed), w, upto: the most that it and those before it can add to a similarity
    (each by the greatest weight that the term has in the conversation), and length: of that part of the vector; both
    bounds are rounded up. The order is the same for all replies of a conversation. Words move once, as hashes."""
    hashed = words.select("conv_id", "pos", F.transform("words", lambda x: F.xxhash64(x)).alias("words"))
    w = term_weights(hashed).where("df > 1").withColumnRenamed("term", "t").withColumn("top", F.max("w").over(Window.partitionBy("conv_id", "t")))
    along = Window.partitionBy("conv_id", "pos").orderBy(F.desc("df"), "t").rowsBetween(Window.unboundedPreceding, 0)
    upto, length = F.sum(F.col("w") * F.col("top")).over(along), F.sqrt(F.sum(F.col("w") * F.col("w")).over(along))
    each = w.select("conv_id", "pos", F.struct((-F.col("df")).alias("rare"), "t", "w", _no_less(upto).alias("upto"), _no_less(length).alias("length")).alias("x"))
    told = each.groupBy("conv_id", "pos").agg(F.sort_array(F.collect_list("x")).alias("terms"))
    return told.select("conv_id", "pos", F.transform("terms", lambda x: x.dropFields("rare")).alias("terms"))


def _indexed(weights: DataFrame, least: float) -> DataFrame:
    """Of each reply the rarest terms, one of which two replies must share to be as similar as `least`: those before them
    add less, for the least of `upto` and `length` bounds that. before: the length of the vector before a term; most, size:
    what the terms that aren't indexed can add at most, and their length. Each reply tells that of its own row."""

    def low(x: Column) -> Column:
        return F.least(x["upto"], x["length"]) < least - SLACK

    most, size = (F.coalesce(F.array_max(F.transform(F.filter("terms", low), lambda x: x[c])), F.lit(0).cast("float")) for c in ("upto", "length"))  # noqa: B023
    told = weights.select("conv_id", "pos", most.alias("most"), size.alias("size"), F.filter("terms", lambda x: ~low(x)).alias("own"))
    told = told.select("conv_id", "pos", "most", "size", F.inline("own"))  # apart, or each term would search its reply anew
    before = F.sqrt(F.greatest(F.col("length") * F.col("length") - F.col("w") * F.col("w"), F.lit(0.0)))
    return told.select("conv_id", "pos", "t", "w", "most", "size", _no_less(before).alias("before"))


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The similarity of each row's two vectors (terms ta, tb and weights wa, wb)."""
    for rows in batches:
        sims = []
        for ta, wa, tb, wb in zip(*(rows[c] for c in ("ta", "wa", "tb", "wb")), strict=True):
            _, x, y = np.intersect1d(ta.values.to_numpy(), tb.values.to_numpy(), assume_unique=True, return_indices=True)
            sims.append(float(wa.values.to_numpy()[x] @ wb.values.to_numpy()[y]))
        sims = np.round(np.clip(np.array(sims), 0, 1), 12)
        yield pa.RecordBatch.from_arrays([rows["conv_id"], rows["i"], rows["j"], pa.array(sims, pa.float64())], names=["conv_id", "i", "j", "sim"])


def _met(weights: DataFrame, least: float, wanted: DataFrame | None = None) -> DataFrame:
    """conv_id, i, j, sim of the pairs with a similarity of at least `least`: i < j, or, given wanted (conv_id, pos), all j
    beside each wanted i.

    The rarest term that two replies share is indexed in both, for else all that they share would add up to less. So only
    indexed terms are joined, and what they add is summed. What else a pair shares is not indexed in one of the two, and
    in the other stands before the first shared term that is: the lengths of both parts bound it. Pairs that can't reach
    `least` by that are dropped, and for the few that remain whole vectors meet, a row each.
    """

    def side(of: DataFrame, pos: str, mark: str) -> DataFrame:
        return _indexed(of, least).select("conv_id", "t", F.col("pos").alias(pos), *[F.col(c).alias(c + mark) for c in ("w", "most", "size", "before")])

    asked = weights if wanted is None else weights.join(wanted.select("conv_id", "pos"), ["conv_id", "pos"], "left_semi")
    a, b = side(asked, "i", "_a"), side(weights, "j", "_b")
    met = a.join(b, ["conv_id", "t"]).where("i < j" if wanted is None else "i <> j")
    rest = F.greatest(F.least("most_a", F.col("size_a") * F.col("before_b")), F.least("most_b", F.col("size_b") * F.col("before_a")))
    part = met.groupBy("conv_id", "i", "j").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("part"), F.min(rest).alias("rest"))
    near = kept(part.where(F.col("part") + F.col("rest") >= least - SLACK).select("conv_id", "i", "j"), "near")

    def vector(pos: str, mark: str) -> DataFrame:
        return weights.select("conv_id", F.col("pos").alias(pos), F.col("terms.t").alias("t" + mark), F.col("terms.w").alias("w" + mark))

    both = near.join(vector("i", "a"), ["conv_id", "i"]).join(vector("j", "b"), ["conv_id", "j"])
    types = ", ".join(f"{c} {near.schema[c].dataType.simpleString()}" for c in ("conv_id", "i", "j"))
    return both.select("conv_id", "i", "j", "ta", "wa", "tb", "wb").mapInArrow(_dots, f"{types}, sim double").where(F.col("sim") >= least)


def threshold_pairs(weights: DataFrame, least: float) -> DataFrame:
    """What tfidf_pairs finds with a similarity of at least `least` (above 0), without summing the pairs below it that share
    common terms only. weights: ordered_weights, written, for it is read three times. No bound on a conversation's replies."""
    return _met(weights, least)


def best_matches(weights: DataFrame, levels: tuple[float, ...] = (0.72, 0.4, 0.2)) -> DataFrame:
    """conv_id, pos, best, best_pos: each reply's greatest similarity to another and the first reply that has it; replies
    that share no term with another are absent.

    Best first: pairs above the highest level settle the replies that have one, for no other pair can be better; the
    replies left are compared at the next level, and the last ones with all that share a term with them.
    """
    left, found = weights.select("conv_id", "pos"), None
    for least in (*levels, None):
        met = _met(weights, SLACK if least is None else least, left)
        best = met.groupBy("conv_id", F.col("i").alias("pos")).agg(F.max("sim").alias("best"), F.max_by("j", F.struct("sim", -F.col("j"))).alias("best_pos"))
        best = kept(best, "best")
        found = best if found is None else found.unionByName(best)
        left = left.join(best, ["conv_id", "pos"], "left_anti")
    return found


def embedding_pairs(vectors: DataFrame) -> DataFrame:
    """The same from unit or other vectors (conv_id, pos, embedding): a second similarity model."""
    v = vectors.withColumn("len", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)))
    a = v.select("conv_id", F.col("pos").alias("i"), F.col("embedding").alias("ea"), F.col("len").alias("la"))
    b = v.select("conv_id", F.col("pos").alias("j"), F.col("embedding").alias("eb"), F.col("len").alias("lb"))
    dot = F.aggregate(F.zip_with("ea", "eb", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    sim = F.coalesce(dot / F.nullif(F.col("la") * F.col("lb"), F.lit(0.0)), F.lit(0.0))
    return a.join(b, "conv_id").where("i < j").select("conv_id", "i", "j", F.least(F.greatest(sim, F.lit(0.0)), F.lit(1.0)).alias("sim"))


def similarity_of(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Similarity of the wanted pairs (conv_id, a, b), in either order: 0 for a missing pair, 1 on the diagonal."""
    asked = wanted.withColumn("i", F.least("a", "b")).withColumn("j", F.greatest("a", "b"))
    got = asked.join(pairs, ["conv_id", "i", "j"], "left")
    return got.select("conv_id", "a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("sim", F.lit(0.0))).alias("sim"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select("conv_id", F.col("j").alias("i"), F.col("i").alias("j"), "sim"))


def timed(pairs: DataFrame, replies: DataFrame) -> DataFrame:
    """Directed pairs (conv_id, i, j, sim, dt) of both directions, dt the whole seconds between them."""
    t = replies.select("conv_id", "pos", "created_at")
    left = t.withColumnsRenamed({"pos": "i", "created_at": "ti"})
    right = t.withColumnsRenamed({"pos": "j", "created_at": "tj"})
    return both_ways(pairs).join(left, ["conv_id", "i"]).join(right, ["conv_id", "j"]).select(
        "conv_id", "i", "j", "sim", F.abs(floor_seconds(F.col("ti"), F.col("tj"))).alias("dt")
    )


def top_edges(directed: DataFrame, config: Config) -> DataFrame:
    """Undirected edges (conv_id, i, j, sim, dt): what each reply's nearest `top_k` similar replies make up."""
    order = Window.partitionBy("conv_id", "i").orderBy(F.desc("sim"), "dt", "j")
    kept = directed.where(F.col("sim") >= config.similar).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_k)
    low, high = F.least("i", "j"), F.greatest("i", "j")
    return kept.groupBy("conv_id", low.alias("i"), high.alias("j")).agg(F.max("sim").alias("sim"), F.min_by("dt", "i").alias("dt"))


def best_of_rows(rows: DataFrame) -> DataFrame:
    """conv_id, pos, best, best_pos of tfidf_rows: each reply's greatest similarity and the first reply that has it."""
    order = F.struct("best", -F.col("best_pos"))
    return rows.groupBy("conv_id", F.col("i").alias("pos")).agg(F.max("best").alias("best"), F.max_by("best_pos", order).alias("best_pos"))


def best_of_pairs(pairs: DataFrame) -> DataFrame:
    """The same of any pairs."""
    by = both_ways(pairs).groupBy("conv_id", F.col("i").alias("pos"))
    return by.agg(F.max("sim").alias("best"), F.max_by("j", F.struct("sim", -F.col("j"))).alias("best_pos"))


def reply_similarity(words: DataFrame, best: DataFrame, close: DataFrame, config: Config) -> DataFrame:
    """Of each reply: max_sim (rounded), most_similar_pos, near_duplicate, neighbour count, mean and first five. best: each
    reply's greatest similarity; close: the directed pairs with a similarity of at least config.similar."""
    stats = close.groupBy("conv_id", F.col("i").alias("pos")).agg(
        F.count("*").alias("neighbours"),
        F.avg("sim").alias("mean"),
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("s"), F.col("j").alias("j")))), 1, 5).alias("first"),
    )
    same = F.count("*").over(Window.partitionBy("conv_id", "digest")) > 1
    n = F.count("*").over(Window.partitionBy("conv_id"))
    if "digest" not in words.columns:  # equal texts meet by it, so texts don't move
        words = words.withColumn("digest", F.sha2(F.array_join("words", " "), 256))
    base = words.select("conv_id", "pos", "reply_id", "account_id", same.alias("same"), n.alias("n"), "lex", "token_count")
    out = base.join(best, ["conv_id", "pos"], "left").join(stats, ["conv_id", "pos"], "left")
    first_other = F.when(F.col("n") < 2, F.lit(None)).when(F.col("pos") == 0, 1).otherwise(0)
    return out.select(
        "conv_id", "pos", "reply_id", "account_id", "lex", "token_count",
        round3(F.coalesce("best", F.lit(0.0))).alias("max_sim"),
        F.when(F.coalesce("best", F.lit(0.0)) > 0, F.col("best_pos")).otherwise(first_other).cast("int").alias("most_similar_pos"),
        (F.col("same") | (F.coalesce("best", F.lit(0.0)) >= config.near_duplicate)).alias("near_duplicate"),
        F.coalesce("neighbours", F.lit(0)).alias("neighbours"),
        round3(F.coalesce("mean", F.lit(0.0))).alias("neighbour_mean"),
        F.coalesce(F.transform("first", lambda x: x["j"]), F.array().cast("array<int>")).alias("first_neighbours"),
    )


def comparisons(replies: DataFrame) -> DataFrame:
    n = F.count("*")
    return replies.groupBy("conv_id").agg((n * (n - 1) / 2).cast("long").alias("comparisons"))
