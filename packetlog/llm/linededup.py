"""Near-duplicate lines by an exact set-similarity join (operator 7).

A line's tokens are the set of its lower-cased words between white space. A line
is removed if an earlier line, in (doc_id, text hash, line number) order, has a
Jaccard similarity of ``PERCENT`` per cent or more with it; whether that earlier
line is removed itself plays no part. Everything runs as DataFrame functions.

1. Words are counted over the whole corpus in ``BUCKETS`` hash buckets. The class of
   a count (its binary logarithm) and the token's hash give one global order, rare
   tokens first; any fixed order keeps the join exact, rarity makes it small.
2. Lines with equal token sets become one node, so hot lines are folded before
   anything is joined. Nodes are numbered in the order of their first places.
3. Prefix filter: similar lines share a token among the first
   n - ceil(t n) + 1 of each, so nodes are joined on their prefix tokens only.
   Tokens that occur once in the corpus are left out. A frequent token (``heavy``:
   far more often than a bucket holds on average) is no key of its own: if the
   first shared token is heavy, so are all others, and the first two of them stand
   in both prefixes extended by one token, so pairs of heavy tokens are keys.
   The join condition holds the length filter, the positional filter (shared
   tokens up to the match, plus what can follow it) and a bit filter (parity of
   the token hashes in 64 bits, 128 for ``LONG`` sets: each token that two lines
   don't share changes at most one), so a join emits hardly more than the true matches.
4. A line needs only one earlier match to go. So a first round compares each node
   just with three before it that share one of three pairs of its tokens: the first,
   the last and the one with most lines. The pairs are those with the least and the
   greatest hashes, and the two that follow 0 in a circle, which similar sets mostly share
   whatever words were changed. A pair's nodes are at most as many as its rarer token's count says;
   above ``2^WINDOW`` they are salted, so a window holds a bounded number of nodes. A node that has a match
   there (verified as in 5) takes part in the full join only as the earlier partner
   of nodes that have none, so groups of m near copies give about m pairs, not m^2.
5. Candidates are verified on the words themselves.
6. A node with an earlier match loses all its lines, others all but the first.
   The removed line numbers are gathered per document and joined to it.

Lines are folded, and tokens compared before step 5, by hashes: two 64-bit hashes
of a set, 56 bits of a word. A chance collision folds two different lines with a
probability of about 2^-112 a pair.

Which lines and texts take part in 5 and 6 is first tested against a bitmap of a
fixed 2^23 bits, so only those and a few more are shuffled.

Edge cases: null text stays null, and lines without words are always kept. Null
ids come first in the order. Rows equal in id and text are one document: they
don't remove each other's lines and come out alike. At 80 per cent, lines
of up to three tokens match equal sets only, which follows from the threshold. An empty table gives an
empty result. Input columns other than text (and n_chars in the pipeline) pass
through, but for the names ``__lines`` and ``__removed`` that ``dedup_lines`` adds:
columns of these names in its input are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetlog.llm import common as C
from packetlog.session import jit_sized_codegen

PERCENT = 80
BUCKETS = 1 << 18
BITS = 1 << 23
#: Least class of a heavy token, and least percentage that heavy pairs are exact for.
HEAVY, PAIRED = 12, 67
#: Nodes that one window of the first round holds at most, as a power of two.
WINDOW = 17
#: Sets of more tokens have 128 bits of parities, others 64.
LONG = 64
WORDS, ODD = r"\s+", ("\t", "\x0b", "\f", "\r")
#: Names of helper columns, unlikely to clash with a table's own.
KEY, NO, GONE = "__text_key", "__line_no", "__gone"


def _dense(rows: DataFrame, size: int) -> DataFrame:
    """One row with ``v``: the array of values ``v`` at ``i`` (0 <= i < size; those
    of one ``i`` are joined by OR, 0 where there is none). ``size`` is fixed, at most
    2^18, and bounds the one task that lines them up. Nothing is broadcast."""
    kind = rows.schema["v"].dataType
    every = rows.sparkSession.range(0, size, 1, 8).select(F.col("id").cast(rows.schema["i"].dataType).alias("i"), F.lit(0).cast(kind).alias("v"))
    full = rows.select("i", "v").unionByName(every).groupBy("i").agg(F.bit_or("v").alias("v"))
    return C.cut(full.agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("v")))


def _bitmap(rows: DataFrame, value: Column) -> Column:
    """A test for membership, with a few false positives: a function of the same
    hash on the other side. Returned as a scalar subquery of the bitmap."""
    bit = F.pmod(value, F.lit(BITS))
    words = rows.select((bit / 64).cast("int").alias("i"), (bit % 64).cast("int").alias("b"))
    return _dense(words.select("i", F.expr("shiftleft(1L, b)").alias("v")), BITS // 64).scalar()


def _maybe(bitmap: Column, value: Column) -> Column:
    bit = F.pmod(value, F.lit(BITS))
    return F.getbit(F.get(bitmap, (bit / 64).cast("int")), (bit % 64).cast("int")) == 1


def _split(rows: DataFrame, text: Column, to: str) -> DataFrame:
    """``rows`` with the lower-cased words of ``text``, and empty strings, in column
    ``to``. The plain split at blanks is faster than the pattern, which few texts
    need; the lower-cased text is a column of its own, so it is made once."""
    low = F.col("__low")
    odd = F.contains(low, F.lit(ODD[0]))
    for c in ODD[1:]:
        odd = odd | F.contains(low, F.lit(c))
    return rows.withColumn("__low", F.lower(text)).withColumn(to, F.when(odd, F.split(low, WORDS)).otherwise(F.split(low, " "))).drop("__low")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text key, line number and line of every line of every text."""
    rows = docs.select(C.DOC_ID, C.text_hash().alias(KEY), F.split(F.col(C.TEXT).cast("string"), "\n").alias("lines"))
    return rows.select(C.DOC_ID, KEY, F.posexplode_outer("lines").alias(NO, "line"))


def _classes(docs: DataFrame) -> tuple[Column, int]:
    """Class of each bucket's word count, as a constant array of BUCKETS bytes (as a
    column of its own it would be copied with every row), and the least class of
    heavy tokens."""
    text = F.replace(F.col(C.TEXT).cast("string"), F.lit("\n"), F.lit(" "))
    words = _split(docs.select(text.alias("text")), F.col("text"), "w").select(F.explode_outer("w").alias("w"))
    bucket = F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1))
    counts = C.cut(words.groupBy(bucket.alias("i")).agg(F.count(F.lit(1)).alias("n")))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    heavy = max(HEAVY, math.floor(math.log2(max(1, mean))) + 3)
    C.release(docs.sparkSession)
    table = _dense(counts.select("i", F.floor(F.log2("n")).cast("tinyint").alias("v")), BUCKETS).first()["v"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<tinyint>"), heavy


def _sets(docs: DataFrame, percent: int) -> DataFrame:
    """Each line with words: its place ``at``, the 128-bit digest (d1, d2) of its
    token set, the set's size ``n``, the parities ``p1`` and ``p2`` (see ``LONG``),
    and its join keys, rare ones first: ``light`` (32-bit token hashes, the first
    one at position ``skip``), ``pairs`` of heavy tokens (hash, position of the
    later one). ``leads``: the pairs of the first round, each with the binary
    logarithm of how many windows its nodes are dealt to."""
    classes, heavy = _classes(docs)
    if percent < PAIRED:
        heavy = 64
    first = lambda c: F.lit(min(c << 56, (1 << 63) - 1)).cast("long")  # noqa: E731  least key of a class

    def class_of(h: Column) -> Column:
        return F.get(classes, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long")

    def key(h: Column) -> Column:
        return F.shiftleft(class_of(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    n = F.size("keys")
    none = F.lit(0).cast("long")

    def parity(bit: Callable[[Column], Column]) -> Column:
        """The bits that an odd number of tokens fall on, by six bits of the token's
        key; ``bit`` is 0 for tokens that don't count."""
        return F.aggregate("keys", none, lambda s, k: s.bitwiseXOR(F.call_function("shiftleft", bit(k), k.bitwiseAND(F.lit(63)).cast("int"))))

    # A long set has 128 bits, and a seventh bit says in which half a token falls; a
    # short one has both halves folded in the first, the second is 0.
    every = parity(lambda k: F.lit(1).cast("long"))
    second = F.when(n > LONG, parity(lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(1).cast("long")))).otherwise(none)

    small = lambda k: F.shiftright(F.shiftleft(k, 32), 32).cast("int")
    known = F.array_distinct(F.array_remove(F.transform("w", lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))
    # Asked of the line, not of its hashes: a filter on these would make them twice.
    rows = _split(_lines(docs).where(F.col("line").rlike(r"\S")), F.col("line"), "w").select(C.DOC_ID, KEY, NO, known.alias("h"))
    rows = rows.withColumns({"up": F.sort_array("h"), "zero": F.array_position(F.sort_array(F.array_append("h", none)), none).cast("int")})

    size = F.size("up")
    places = [*(F.lit(k) for k in (1, 2, -1, -2)), F.pmod(F.col("zero") - 1, size) + 1, F.pmod(F.col("zero"), size) + 1]
    rows = rows.select(C.DOC_ID, KEY, NO, F.col("up").alias("h"), F.array(*[F.try_element_at("up", k) for k in places]).alias("ends"))
    rows = rows.withColumn("kinds", F.transform("ends", class_of))

    def lead(k: int) -> Column:
        most = F.least(F.get("kinds", F.lit(k)), F.get("kinds", F.lit(k + 1)))
        token = F.xxhash64(F.lit(k), F.get("ends", F.lit(k)), F.get("ends", F.lit(k + 1)))
        return F.struct(token.alias("token"), F.greatest(most - WINDOW, F.lit(0)).cast("tinyint").alias("salt"))

    leads = F.array(*[lead(k) for k in (0, 2, 4)])
    keys = F.sort_array(F.transform("h", key))
    rows = rows.select(F.struct(C.DOC_ID, KEY, NO).alias("at"), keys.alias("keys"), leads.alias("leads"))
    rows = rows.withColumns({"every": every, "second": second, "length": n - F.ceil(n * percent / 100).cast("int") + 1})
    prefix = F.slice("keys", F.lit(1), F.col("length"))
    rows = rows.withColumn("prefix", F.filter(prefix, lambda k: (k >= first(1)) & (k < first(heavy))))
    # Keys are in order, so heavy ones stand behind all others.
    longer = F.slice("keys", F.lit(1), F.least(F.col("length") + 1, n))
    behind = F.size(F.filter(longer, lambda k: k < first(heavy)))
    later = lambda i: F.transform(F.sequence(i + 1, F.size(longer) - 1), lambda j: F.struct(
        small(F.xxhash64(F.get("keys", i), F.get("keys", j))).alias("token"), j.alias("i")))
    pairs = F.when(F.element_at(longer, -1) >= first(heavy), F.when(F.size(longer) - behind >= 2, F.flatten(F.transform(F.sequence(behind, F.size(longer) - 2), later))))
    # The class of a token that occurs once is 0: such tokens stand in front.
    skip = F.size(F.filter(prefix, lambda k: k < first(1)))
    return rows.select("at", F.xxhash64("keys").alias("d1"), F.xxhash64(F.lit(1), "keys").alias("d2"), n.alias("n"), F.col("every").bitwiseXOR(F.col("second")).alias("p1"), F.col("second").alias("p2"),
                       skip.alias("skip"), F.transform("prefix", small).alias("light"), pairs.alias("pairs"), "leads")


FACTS = ("n", "p1", "p2", "skip", "light", "pairs", "leads")


def _nodes(sets: DataFrame) -> DataFrame:
    """One row per distinct set: its first place, the number of its lines and the
    columns of ``_sets``, numbered by ``node`` in the order of the places."""
    facts = F.struct(*FACTS).alias("facts")
    rows = sets.select("d1", "d2", "at", facts).groupBy("d1", "d2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("lines"), F.any_value("facts").alias("facts"))
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "at").sortWithinPartitions("at")
    return rows.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "at", "lines", "facts.*")


def _rows(nodes: DataFrame, percent: int, free: Column) -> DataFrame:
    """(token, node, p1, p2, pack) for the keys of nodes that can have a match other
    than an equal set: at best one that has one token more. pack: the set's size,
    the token's position, whether the key is a pair, and ``free``."""
    def packed(i: Column, pair: int) -> Column:
        return F.shiftleft(F.col("n").cast("long"), 33).bitwiseOR(F.shiftleft(i.cast("long"), 2)).bitwiseOR(F.lit(2 * pair).cast("long")).bitwiseOR(free.cast("long")).alias("pack")

    used = nodes.where(F.col("n") * 100 >= (F.col("n") + 1) * percent)
    one = used.select("node", "n", "p1", "p2", "skip", free.alias("free"), F.posexplode("light").alias("i", "token"))
    two = used.where("pairs IS NOT NULL").select("node", "n", "p1", "p2", free.alias("free"), F.explode("pairs").alias("pair"))
    free = F.col("free")
    return one.select("token", "node", "p1", "p2", packed(F.col("skip") + F.col("i"), 0)).unionByName(
        two.select(F.col("pair.token").alias("token"), "node", "p1", "p2", packed(F.col("pair.i"), 1)))


def _similar(a: str, b: str, percent: int) -> Column:
    """Length, positional and bit filter on the columns of two rows (name prefixes
    ``a`` and ``b``) with one key."""
    n = [F.shiftright(x + "pack", 33) for x in (a, b)]
    i = [F.shiftright(x + "pack", 2).bitwiseAND(F.lit((1 << 31) - 1)) for x in (a, b)]
    shared = [F.shiftright(x + "pack", 1).bitwiseAND(F.lit(1)) for x in (a, b)]
    both = n[0] + n[1]
    overlap = F.ceil(both * percent / (100 + percent))
    length = F.least(*n) * 100 >= F.greatest(*n) * percent
    position = shared[0] + 1 + F.least(n[0] - i[0] - 1, n[1] - i[1] - 1) >= overlap
    apart = [F.col(a + p).bitwiseXOR(F.col(b + p)) for p in ("p1", "p2")]
    differ = F.when(F.least(*n) > LONG, F.bit_count(apart[0]) + F.bit_count(apart[1])).otherwise(F.bit_count(apart[0].bitwiseXOR(apart[1])))
    return (shared[0] == shared[1]) & length & position & (differ <= both - 2 * overlap)


def _leads(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): one possible earlier match ``a`` of each node ``b`` that has one in
    the first round."""
    used = nodes.where(F.col("n") * 100 >= (F.col("n") + 1) * percent)
    keys = used.select("node", "lines", "n", "p1", "p2", F.explode("leads").alias("lead")).withColumn("token", F.col("lead.token"))
    salt = F.pmod(F.xxhash64("node"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("lead.salt").cast("int")))
    # Position 0: the filter by positions holds for the first shared token only.
    row = F.struct("node", "p1", "p2", F.shiftleft(F.col("n").cast("long"), 33).alias("pack")).alias("row")
    keys = keys.select("token", salt.alias("salt"), "node", "lines", row)
    order = Window.partitionBy("token", "salt").orderBy("node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.select("row", F.first("row").over(before).alias("first"), F.lag("row").over(order).alias("last"),
                       F.max(F.struct("lines", "row")).over(before)["row"].alias("most"))
    found = [F.when(_similar(f"{x}.", "row.", percent), F.col(f"{x}.node")) for x in ("most", "first", "last")]
    pairs = keys.select(F.col("row.node").alias("b"), F.coalesce(*found).alias("a")).where("a IS NOT NULL")
    return pairs.groupBy("b").agg(F.min("a").alias("a"))


def _flagged(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """``nodes`` with ``free``: 0 for those in ``marked`` (column ``node``)."""
    maybe = _maybe(_bitmap(marked, F.xxhash64("node")), F.xxhash64("node"))
    flag = marked.select("node").distinct().withColumn("hit", F.lit(1))
    some = nodes.where(maybe).join(flag, "node", "left").withColumn("free", F.when(F.col("hit").isNull(), 1).otherwise(0)).drop("hit")
    return nodes.where(~maybe).withColumn("free", F.lit(1)).unionByName(some)


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """The pairs (a, b) that are similar by their words, with ``jaccard``, staged."""
    spark = docs.sparkSession
    place = F.xxhash64(f"at.{C.DOC_ID}", f"at.{KEY}", f"at.{NO}")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ends, ends_path = C.stage(nodes.select("node", "at").join(ends, "node"))
    lines = _lines(docs).select(F.struct(C.DOC_ID, KEY, NO).alias("at"), "line").where(_maybe(_bitmap(ends, place), place))
    # Equal documents give a place twice; its words are the same.
    ends = ends.withColumnRenamed("at", "place")
    texts, texts_path = C.stage(lines.join(ends, F.col("at").eqNullSafe(F.col("place"))).dropDuplicates(["node"]).select("node", "line"))
    C.drop(spark, ends_path)
    found = pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("node").alias("b"), F.col("line").alias("lb")), "b")
    found = _split(_split(found, F.col("la"), "wa"), F.col("lb"), "wb")
    known = lambda c: F.array_distinct(F.array_remove(c, F.lit("")))
    found = found.select("a", "b", known("wa").alias("wa"), known("wb").alias("wb"))
    found = found.select("a", "b", (F.size("wa") + F.size("wb")).alias("n"), F.size(F.array_intersect("wa", "wb")).alias("o"))
    found, path = C.stage(found.select("a", "b", "o", (F.col("n") - F.col("o")).alias("u")))
    C.drop(spark, texts_path)
    C.release(spark)
    # Only now: a filter before the words are counted would count them again.
    return found.where(F.col("o") * 100 >= F.col("u") * percent).select("a", "b", (F.col("o") / F.col("u")).alias("jaccard")), path


def similar_lines(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, list[str]]:
    """Verified pairs of nodes: one or more earlier matches ``a`` of every node
    ``b`` that has any, with their ``jaccard``; and the folders that hold them, for
    ``drop``."""
    spark = docs.sparkSession
    with jit_sized_codegen(spark):
        pairs, pairs_path = C.stage(_leads(nodes, percent))
    C.release(spark)
    easy, easy_path = _verified(docs, nodes, pairs, percent)
    C.drop(spark, pairs_path)
    # Staged, so both sides of the join are one shuffle: plans with bitmaps count as different.
    flagged = _flagged(nodes, easy.select(F.col("b").alias("node"))).select("node", "n", "p1", "p2", "skip", "light", "pairs", "free")
    flagged, flagged_path = C.stage(flagged)
    rows = _rows(flagged, percent, F.col("free"))
    a, b = rows.alias("a"), rows.alias("b")
    # The later node is free, as one condition on both sides: a filter of one side
    # would make two shuffles of the same rows.
    wanted = (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node") * F.col("b.pack").bitwiseAND(F.lit(1).cast("long")))
    full = a.join(b, wanted & _similar("a.", "b.", percent)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    full, full_path = C.stage(full.distinct())
    C.drop(spark, flagged_path)
    C.release(spark)
    hard, hard_path = _verified(docs, nodes, full, percent)
    C.drop(spark, full_path)
    return easy.unionByName(hard), [easy_path, hard_path]


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, text key and the array of removed line numbers of each
    document that loses lines."""
    spark = docs.sparkSession
    full, full_path = C.stage(_sets(docs, percent))
    C.release(spark)
    nodes, nodes_path = C.stage(_nodes(full))
    sets, sets_path = C.stage(full.select("at", "d1", "d2"))
    C.drop(spark, full_path)
    C.release(spark)
    matches, paths = similar_lines(docs, nodes, percent)
    late = matches.select(F.col("b").alias("node")).distinct()
    marked = _flagged(nodes.select("node", "d1", "d2", "at", "lines"), late).where("free = 0 OR lines > 1")
    marked, marked_path = C.stage(marked.select("d1", "d2", F.when(F.col("free") == 1, F.col("at")).alias("keep")))
    C.drop(spark, nodes_path, *paths)
    places = sets.where(_maybe(_bitmap(marked, F.col("d1")), F.col("d1")))
    gone = places.join(marked, ["d1", "d2"]).where("keep IS NULL OR at <> keep").select("at.*")
    gone = C.cut(gone.groupBy(C.DOC_ID, KEY).agg(F.collect_set(NO).alias(GONE)))
    C.drop(spark, sets_path, marked_path)
    C.release(spark)
    return gone


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with its removed lines taken out of ``text``, and two further
    columns ``__lines`` and ``__removed`` (numbers of lines)."""
    docs = docs.drop("__lines", "__removed")
    gone = removed_lines(docs, percent).select(F.col(C.DOC_ID).alias("__gone_id"), F.col(KEY).alias("__gone_key"), F.col(GONE).alias("__gone_no"))
    names = {c.lower() for c in docs.columns}
    free = lambda c: next(x for x in (c, *(f"{c}{k}" for k in range(len(names) + 1))) if x.lower() not in names)
    own, id_, key, no = (free(c) for c in (KEY, "__gone_id", "__gone_key", "__gone_no"))
    gone = gone.withColumnsRenamed({"__gone_id": id_, "__gone_key": key, "__gone_no": no})
    rows = docs.withColumn(own, C.text_hash())
    changed = _maybe(_bitmap(gone, F.xxhash64(id_, key)), F.xxhash64(C.DOC_ID, own))
    same = F.col(C.DOC_ID).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key))
    lines = F.split(F.col(C.TEXT).cast("string"), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(no), i)), "\n")
    number = F.coalesce(F.size(lines), F.lit(0)).alias("__lines")
    text = F.col(C.TEXT).cast("string")

    def out(part: DataFrame, new: Column, removed: Column) -> DataFrame:
        columns = [new.alias(c) if c == C.TEXT else F.col(c) for c in docs.columns]
        return part.select(*columns, number, removed.alias("__removed"))

    # Texts that lose nothing stay where they are.
    some = out(rows.where(changed).join(gone, same, "left"), F.when(F.col(no).isNull(), text).otherwise(kept), F.coalesce(F.array_size(no), F.lit(0)))
    return out(rows.where(~changed), text, F.lit(0)).unionByName(some)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents
), sets AS (
  SELECT row_number() OVER (ORDER BY doc_id, no) AS pos, doc_id, no,
         list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))) AS ws FROM lines
), nodes AS (
  SELECT ws, min(pos) AS pos, len(ws) AS n FROM sets WHERE len(ws) > 0 GROUP BY ws
), toks AS (SELECT pos, n, unnest(ws) AS w FROM nodes
), freq AS (SELECT w, count(*) AS f FROM toks GROUP BY w
), pre AS (
  SELECT pos, n, w FROM (SELECT pos, n, w, row_number() OVER (PARTITION BY pos ORDER BY f, w) AS i FROM toks JOIN freq USING (w)) x
  WHERE i <= n - CAST(ceil(n * 80 / 100) AS BIGINT) + 1
), cand AS (
  SELECT DISTINCT a.pos AS a, b.pos AS b FROM pre a JOIN pre b ON a.w = b.w AND a.pos < b.pos AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
), late AS (
  SELECT DISTINCT c.b AS pos FROM cand c JOIN nodes x ON x.pos = c.a JOIN nodes y ON y.pos = c.b
  WHERE len(list_intersect(x.ws, y.ws)) * 100 >= (x.n + y.n - len(list_intersect(x.ws, y.ws))) * 80
), gone AS (
  SELECT s.doc_id, s.no FROM sets s JOIN nodes d ON d.ws = s.ws
  WHERE s.pos <> d.pos OR d.pos IN (SELECT pos FROM late)
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) FILTER (WHERE g.no IS NULL) AS text, count(*) AS n_lines, count(g.no) AS n_removed
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.no = l.no GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
