"""Operator 3, line dedup: segment-partition edit join, native.

A line goes if an earlier line (smaller document id, then place) is equal to it, or within
``tau`` edits of it. Equal lines: distinct lines are found by a grouped minimum over their
128-bit hashes. Similar lines: every distinct line of at least ``near_chars`` characters is
split into tau + 1 segments; two lines within tau edits share a segment, at a place that
differs by no more than the edits to its left and right allow. So the segments of all lines,
keyed by line length, segment number and content, are an index, and each line probes it with
the substrings that can match (itself or a longer line, multi-match-aware places only), all
as hashed keys. A grouped minimum and maximum tells which keys more than one line has; only lines
under these are read again. A segment that many lines have (a template's words) is split by what
they share besides: without the shared segment two such lines are still within tau edits, so
their rests are cut into segments and met in the same way. A candidate survives if the counts of
``LETTERS`` differ by no more than tau edits can make them differ (2 tau, less the difference of
the lengths), which the join tests itself; then the lines, without their common start and end, are
verified by banded bit-parallel edit distance (a band of 2 tau + 1 bits slides along the diagonal,
one step per character). A line with any verified earlier neighbour goes.

Lines are compared without white space at their ends; lines that are blank then (shorter than
``min_chars``) are left alone, as are the line breaks of what stays. Texts are never shuffled before
candidates are known; the last join of documents with their dropped places is by document.

Defined results: a null text stays null, an empty one empty; a document whose lines all go
keeps its row with an empty text; equal lines of one document keep the first; rows with the
same id are told apart by a hash of their text, and exact repetitions of a whole row keep
their own lines decided alike; null ids come first; an empty table gives no rows; other
columns are kept unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepline.llm.common import HEAVY_SHARE, ceil_div, cut, keyed_join

TAU = 2
MIN_CHARS = 1
#: two edits in a shorter line make another line: another number, name or list entry
NEAR_CHARS = 24
#: words of packed counts; white space is often most of what the common letters leave
LETTERS = ("etaoinsrhldu", "cmgpbfvwkyz ", "0123456789jx")
#: shared segments and candidate lines up to this many are fetched through a broadcast of their hashes
BROADCAST_LINES = 200_000
#: a count's remainder by ten as five bits, so that as many bits differ as there are steps between two
#: remainders on the ring of ten
RING = [(1 << v) - 1 for v in range(6)] + [32 - (1 << v) for v in range(1, 5)]
PAIRS_PER_TASK = 2_000
#: a segment under which more pairs than this meet is split by the rests of its lines
HOT_PAIRS = 250_000
#: rests shorter than this are not split any further
SHORT_REST = 12
BLANKS = " \t\n\x0b\x0c\r"


def line_key(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, mark, place, norm: lines long enough to be compared."""
    split = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.split("text", "\n", -1).alias("lines"))  # once a text, not once a line
    raw = split.select("doc_id", "mark", F.posexplode("lines").alias("place", "line"))
    return raw.withColumn("norm", F.btrim("line", F.lit(BLANKS))).drop("line").where(F.length("norm") >= min_chars)


def segments(n: Column, tau: int) -> list[tuple[Column, Column]]:
    """(start from 1, length) of the tau + 1 even segments of a string of n characters: the last
    ones are longer by one where it does not divide."""
    short = F.floor(n / (tau + 1)).cast("int")
    longer = n - short * (tau + 1)
    first_long = tau + 1 - longer
    out = []
    for i in range(tau + 1):
        extra = F.greatest(F.lit(0), F.lit(i) - first_long).cast("int")
        out.append((short * i + extra + 1, short + (F.lit(i) >= first_long).cast("int")))
    return out


def matches(n: Column, tau: int, both_ways: bool = False) -> list[tuple[Column, int, Column, Column, bool]]:
    """Where a line of n characters can equal a segment of a line as long or up to tau shorter: for
    segment i of a line shorter by d, places p - i .. p + i that also lie in
    p + d - (tau - i) .. p + d + (tau - i). (length of the shorter line, i, start, length, whether it is
    the line's own segment). Of two lines equally long either one probes the other, so places to the
    left are left out there, unless ``both_ways``."""
    out = []
    for d in range(tau + 1):
        shorter = n - d
        for i, (p, w) in enumerate(segments(shorter, tau)):
            for shift in range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1):
                if d == 0 and shift < 0 and not both_ways:
                    continue
                out.append((shorter, i, p + shift, w, d == 0 and shift == 0))
    return out


def segment_keys(norm: Column, n: Column, tau: int, *prefix: Column, both_ways: bool = False) -> Column:
    """The hashed substrings of a line at its ``matches``; those of its own segments are its index."""
    return F.array(*[F.xxhash64(*prefix, shorter, F.lit(i), F.substring(norm, start, w)) for shorter, i, start, w, _ in matches(n, tau, both_ways)])


def own_segment(k: Column, tau: int, both_ways: bool = False) -> Column:
    return k.isin([j for j, m in enumerate(matches(F.lit(0), tau, both_ways)) if m[4]])


def without_match(norm: Column, k: Column, tau: int, both_ways: bool = False) -> Column:
    """A line less the substring of its match number k."""
    at = matches(F.length(norm), tau, both_ways)
    start, w = F.get(F.array(*[m[2] for m in at]), k), F.get(F.array(*[m[3] for m in at]), k)
    return F.concat(F.substring(norm, F.lit(1), start - 1), F.substring(norm, start + w, F.length(norm)))


def letter_counts(norm: Column) -> Column:
    """Counts of LETTERS, five bits each (``RING``), one long per word of LETTERS. Letters are taken
    out one after the other, so each step reads a shorter rest."""
    ring = F.array(*[F.lit(v).cast("long") for v in RING])

    def out(s: Column, c: Column) -> Column:
        # the count of the letter taken out before this step shows in the rest's bytes now
        here = F.octet_length(s.rest)
        return F.struct(F.replace(s.rest, c, F.lit("")).alias("rest"), here.alias("n"), packed(s, here).alias("packed"))

    def packed(s: Column, here: Column) -> Column:
        return F.shiftleft(s.packed, 5) + F.get(ring, (s.n - here) % 10)

    def done(s: Column) -> Column:
        return F.struct(s.rest.alias("rest"), packed(s, F.octet_length(s.rest)).alias("packed"))

    def word(rest: Column, letters: str) -> Column:
        start = F.struct(rest.alias("rest"), F.octet_length(rest).alias("n"), F.lit(0).cast("long").alias("packed"))
        return F.aggregate(F.array(*[F.lit(c) for c in letters]), start, out, done)

    def rest(a: Column) -> Column:
        return F.get(F.transform(F.array(word(a.rest, LETTERS[1])), lambda b: F.struct(a.packed.alias("a"), b.packed.alias("b"), word(b.rest, LETTERS[2]).packed.alias("c"))), F.lit(0))

    return F.get(F.transform(F.array(word(norm, LETTERS[0])), rest), F.lit(0))


def letters_apart(a: Column, b: Column) -> Column:
    """A lower bound of the sum of the letters' differences (differences taken around a ring of ten)."""
    return F.bit_count(a.bitwiseXOR(b))


def edits(p: Column, t: Column, n: Column, m: Column, tau: int) -> Column:
    """Edit distance of two strings given as arrays of characters, p of m and t of n characters,
    m <= n <= m + tau; exact up to tau, larger than tau if the distance is.

    Bit k of a column's vectors stands for row j - tau + k in column j. ``up`` and ``down``
    tell where the distance rises or falls from the row above; the score follows the
    diagonal and is corrected from row n to row m at the end."""
    width = 2 * tau + 1
    full = (1 << width) - 1
    lit = lambda v: F.lit(v).cast("long")
    both = lambda x, y: x.bitwiseAND(y)
    flip = lambda x: lit(full) - both(x, lit(full))

    def step(s: Column, j: Column) -> Column:
        ch = F.get(t, j - 1)
        eq = lit(0)
        for k in range(width):
            eq = eq + F.when(F.get(p, j - tau + k - 1) == ch, lit(1 << k)).otherwise(lit(0))
        return F.struct(F.shiftright(s.up, 1).bitwiseOR(lit(1 << (width - 1))).alias("up"), F.shiftright(s.down, 1).alias("down"), eq.alias("eq"), s.score.alias("score"))

    def d0(s: Column) -> Column:
        return both((both(s.eq, s.up) + s.up).bitwiseXOR(s.up).bitwiseOR(s.eq).bitwiseOR(s.down), lit(full))

    def turn(s: Column) -> Column:
        d = s.d0
        x = F.shiftleft(s.down.bitwiseOR(flip(d.bitwiseOR(s.up))), 1).bitwiseOR(lit(1))
        y = F.shiftleft(both(d, s.up), 1)
        return F.struct(
            both(y.bitwiseOR(flip(d.bitwiseOR(x))), lit(full)).alias("up"),
            both(both(x, d), lit(full)).alias("down"),
            (s.score + F.when(both(d, lit(1 << tau)) == 0, lit(1)).otherwise(lit(0))).alias("score"),
        )

    def column(s: Column, j: Column) -> Column:
        # the last corrections lower the score by n - m at most: beyond that it is decided
        done = F.struct(s.up.alias("up"), s.down.alias("down"), s.score.alias("score"))
        return F.when(s.score > tau + n - m, done).otherwise(live(s, j))

    def live(s: Column, j: Column) -> Column:
        # a struct in an array of one, so that what is used twice is computed once
        first = F.transform(F.array(step(s, j)), lambda v: F.struct(v.up.alias("up"), v.down.alias("down"), v.score.alias("score"), d0(v).alias("d0")))
        return F.get(F.transform(first, turn), F.lit(0))

    def finish(s: Column) -> Column:
        score = s.score
        for k in range(tau):
            bit = tau - k
            fix = F.when(both(s.up, lit(1 << bit)) > 0, lit(-1)).when(both(s.down, lit(1 << bit)) > 0, lit(1)).otherwise(lit(0))
            score = score + F.when(n - m > k, fix).otherwise(lit(0))
        return score

    below = sum(1 << k for k in range(tau + 1, width))
    start = F.struct(lit(below).alias("up"), lit(0).alias("down"), lit(0).alias("score"))
    return F.aggregate(F.sequence(F.lit(1), n), start, column, finish)


def common_start(a: Column, b: Column, shorter: Column) -> Column:
    """How many characters a and b have in common at their start (``shorter``: the least length)."""
    powers = F.reverse(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(shorter, F.lit(1)))).cast("int"))))

    def more(done: Column, k: Column) -> Column:
        w = F.pow(F.lit(2), k).cast("int")
        return F.when((done + w <= shorter) & (F.substring(a, done + 1, w) == F.substring(b, done + 1, w)), done + w).otherwise(done)

    return F.aggregate(powers, F.lit(0), more)


def cores(pairs: DataFrame) -> DataFrame:
    """pairs (p, t, p no longer than t, not equal) without their common start and end, which do not
    change the edit distance: p, t, m, n."""
    d = pairs.withColumn("m", F.length("p")).withColumn("cut", common_start(F.col("p"), F.col("t"), F.col("m")))
    d = cut(d.withColumns({c: F.reverse(F.substring(c, F.col("cut") + 1, F.length(c))) for c in ("p", "t")}).withColumn("m", F.length("p")))
    d = d.withColumn("cut", common_start(F.col("p"), F.col("t"), F.col("m")))
    d = d.withColumns({c: F.reverse(F.substring(c, F.col("cut") + 1, F.length(c))) for c in ("p", "t")})
    return d.withColumns({"m": F.length("p"), "n": F.length("t")}).drop("cut")


def small(keys: DataFrame) -> DataFrame:
    """Distinct hashes, to be sent to all tasks if there are at most BROADCAST_LINES of them."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_LINES else keys


def met_segments(base: DataFrame, tau: int) -> DataFrame:
    """base (id, keys) -> segment, id, k: the keys of lines under segments that another line has too."""
    rows = base.where("keys is not null").select("id", F.posexplode("keys").alias("k", "segment"))
    own = F.max(own_segment(F.col("k"), tau).cast("int"))
    met = rows.groupBy("segment").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), own.alias("own")).where("lo <> hi and own = 1")
    met = cut(met.select("segment"))
    return cut(rows.join(small(met), "segment", "left_semi").distinct())


def lighter_groups(met: DataFrame, texts: DataFrame, tau: int, hot_pairs: int) -> DataFrame:
    """met (segment, id, k), texts (id, norm) -> segment, id, own, blocks.

    Lines within tau edits that share a segment are within tau edits without it, so a group of more than
    ``hot_pairs`` pairs is split by what its lines share in their rests, again and again. A group whose
    rests are shorter than ``SHORT_REST`` stays as it is and is met in blocks."""
    r = met.withColumn("own", own_segment(F.col("k"), tau))
    done = []
    first = True
    while True:
        sizes = r.groupBy("segment").agg((F.count_if(F.col("own")) * F.count(F.lit(1))).alias("pairs"))
        hot = cut(sizes.where(F.col("pairs") > hot_pairs))
        if hot.isEmpty():
            done.append(r.select("segment", "id", "own", F.lit(1).alias("blocks")))
            break
        done.append(r.join(hot, "segment", "left_anti").select("segment", "id", "own", F.lit(1).alias("blocks")))
        r = r.join(hot, "segment")
        if first:
            r = r.join(texts.select("id", F.col("norm").alias("rest")), "id")
        r = cut(r.withColumn("rest", without_match(F.col("rest"), F.col("k"), tau, not first)))
        stay = F.length("rest") < SHORT_REST
        # index rows of a group are equally long, the others longer: all of a group's pairs stay or none,
        # but for groups at the border, whose shorter rows are met both ways
        border = F.length("rest") < SHORT_REST + tau
        blocks = F.ceil(F.col("pairs") / hot_pairs).cast("int")
        done.append(r.where(border).select("segment", "id", (F.col("own") & stay).alias("own"), blocks.alias("blocks")))
        n = F.length("rest")
        r = r.where(~stay).select("id", "own", "rest", F.posexplode(segment_keys(F.col("rest"), n, tau, F.col("segment"), both_ways=True)).alias("k", "next"))
        r = cut(r.select(F.col("next").alias("segment"), "id", "k", "rest", (F.col("own") & own_segment(F.col("k"), tau, True)).alias("own")))
        first = False
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def near_lines(lines: DataFrame, base: DataFrame, tau: int) -> DataFrame:
    """lines (doc_id, mark, place, norm), base (id, keys) -> the keys of distinct lines that have an
    earlier line within tau edits."""
    met = met_segments(base, tau)
    texts = lines.withColumn("id", F.xxhash64("norm")).join(small(cut(met.select("id").distinct())), "id", "left_semi")
    texts = texts.groupBy("id", "norm").agg(F.min(F.struct("doc_id", "mark", "place")).alias("first"))
    texts = cut(texts.withColumns({"n": F.length("norm"), "letters": letter_counts(F.col("norm"))}))
    rows = lighter_groups(met, texts, tau, HOT_PAIRS).join(texts.select("id", "n", "letters"), "id")
    block = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    p = rows.where("own").select("segment", block.alias("block"), F.col("id").alias("id_p"), F.col("letters").alias("letters_p"), F.col("n").alias("n_p"))
    t = rows.select("segment", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("id_t"), F.col("letters").alias("letters_t"), F.col("n").alias("n_t"))
    # a substitution changes two counts by one, a character more or less a single one
    longer = F.col("n_t") - F.col("n_p")
    most = 2 * tau - longer
    apart = F.lit(0)
    fits = (F.col("id_p") != F.col("id_t")) & longer.between(0, tau)
    for word in ("a", "b", "c"):
        apart = apart + letters_apart(F.col(f"letters_p.{word}"), F.col(f"letters_t.{word}"))
        fits = fits & (apart <= most)
    found = p.join(t, ["segment", "block"]).where(fits)
    pairs = cut(found.select(F.least("id_p", "id_t").alias("a"), F.greatest("id_p", "id_t").alias("b")).distinct())
    texts = texts.select("id", F.struct("norm", "first").alias("line"))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    swap = F.length("x.norm") <= F.length("y.norm")
    both = both.select("a", "b", "x", "y", F.when(swap, F.col("x.norm")).otherwise(F.col("y.norm")).alias("p"), F.when(swap, F.col("y.norm")).otherwise(F.col("x.norm")).alias("t"))
    # verification is work of the processor, not of volume: dealt out by the number of pairs
    both = both.repartition(ceil_div(pairs.count(), PAIRS_PER_TASK) + 1, "a", "b").drop("a", "b")
    both = cores(both.where((F.length("t") - F.length("p") <= tau) & (F.col("p") != F.col("t"))))
    chars = cut(both.select("x", "y", "m", "n", F.split("p", "").alias("ps"), F.split("t", "").alias("ts")))
    close = chars.where(edits(F.col("ps"), F.col("ts"), F.col("n"), F.col("m"), tau) <= tau)
    later = F.when(F.col("x.first") > F.col("y.first"), F.col("x.norm")).otherwise(F.col("y.norm"))
    return close.select(line_key(later).alias("key")).distinct()


def dropped_lines(docs: DataFrame, tau: int, min_chars: int, near_chars: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, mark, drops (places), near (how many go as similar lines)."""
    lines = lines_of(docs, min_chars)
    n = F.length("norm")
    keys = F.when(n >= near_chars, segment_keys(F.col("norm"), n, tau))
    # all that is needed of most lines, written once: hashes, no texts
    base = cut(lines.select(line_key(F.col("norm")).alias("key"), "doc_id", "mark", "place", F.xxhash64("norm").alias("id"), keys.alias("keys")))
    found = cut(near_lines(lines, base, tau))
    repeated = base.select("key", F.struct("doc_id", "mark", "place").alias("at"))
    firsts = repeated.groupBy("key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    known = firsts.join(found.withColumn("near", F.lit(True)), "key", "full")
    known = cut(known.select("key", "first", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("near", F.lit(False)).alias("near")))
    total = docs.count()
    heavy = known.where(F.col("copies") * HEAVY_SHARE >= total * 2)
    gone = keyed_join(repeated, known.select("key", "first", "near"), "key", heavy).where(F.col("near") | (F.col("first") != F.col("at")))
    return gone.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.mark").alias("mark")).agg(
        F.collect_set("at.place").alias("drops"), F.count_if(F.col("near")).alias("near")
    )


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with all columns -> the same rows with ``text`` less its repeated lines, and n_lines,
    n_dropped and n_near (of those, lines that were similar, not equal)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drops = dropped_lines(d, tau, min_chars, near_chars).select(
        F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("drops").alias("_drops"), F.col("near").alias("_near")
    )
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_mark"))
    j = docs.join(drops, same, "left").withColumn("_lines", F.split("text", "\n", -1))
    n = F.coalesce(F.size("_lines"), F.lit(0))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drops"))
    text = F.when(F.col("_drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get("_lines", i)), "\n"))
    out = j.withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(n).cast("long"),
        "n_dropped": F.coalesce(F.size("_drops"), F.lit(0)).cast("long"),
        "n_near": F.coalesce(F.col("_near"), F.lit(0)).cast("long"),
        "_new": text,
    })
    out = out.withColumns({"text": F.col("_new"), "n_dropped": F.greatest("n_dropped", F.lit(0))})
    return out.drop("_id", "_mark", "_drops", "_near", "_lines", "_new")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    from prepline.llm.common import table

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: the same by definition: every line against every earlier one of nearly its length
OP3_SQL = rf"""
WITH l AS (
  SELECT doc_id, i - 1 AS place, trim(x[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS norm
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), unnest(range(1, len(x) + 1)) AS u(i)),
c AS (SELECT * FROM l WHERE length(norm) >= {MIN_CHARS}),
f AS (SELECT norm, min((doc_id, place)) AS first, length(norm) AS n FROM c GROUP BY norm),
g AS (
  SELECT *, [len(norm) - len(replace(norm, z, '')) FOR z IN ['e','t','a','o','i','n','s','r','h','l','d','u','c']] AS k
  FROM f WHERE n >= {NEAR_CHARS}),
b AS (
  SELECT DISTINCT y.norm FROM g x, generate_series(-{TAU}, {TAU}) AS d(s), g y
  WHERE x.n + s = y.n AND x.first < y.first
    AND list_sum([abs(p[1] - p[2]) FOR p IN list_zip(x.k, y.k)]) <= {2 * TAU}
    AND levenshtein(x.norm, y.norm) <= {TAU}),
o AS (
  SELECT c.doc_id, c.place, b.norm IS NOT NULL AS near, b.norm IS NOT NULL OR (c.doc_id, c.place) <> f.first AS gone
  FROM c JOIN f USING (norm) LEFT JOIN b USING (norm)),
e AS (SELECT doc_id, list(place) AS drops, count(*) AS k, count(*) FILTER (near) AS nr FROM o WHERE gone GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN drops IS NULL THEN text ELSE coalesce(
    array_to_string([y.v FOR y IN list_filter([{{'v': x[i], 'i': i - 1}} FOR i IN range(1, len(x) + 1)], lambda y: NOT list_contains(drops, y.i))], chr(10)), '') END AS text,
  coalesce(len(x), 0)::BIGINT AS n_lines, coalesce(k, 0)::BIGINT AS n_dropped, coalesce(nr, 0)::BIGINT AS n_near
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents) d LEFT JOIN e USING (doc_id)
"""
