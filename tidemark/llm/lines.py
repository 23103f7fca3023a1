"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line is a list of units: its words, or, where its characters with blanks take more than two bytes each on average (scripts that put no
blanks between words), its characters but blanks. Lines with equal units are copies, whatever their length. Two lines of ``fuzzy_units`` units
or more are also alike when one unit inserted, deleted or replaced turns one into the other. Two such lines always share a variant: the
line without its p-th unit, for a replaced unit with the same p on both sides, for an inserted one the
variant of one line is the other line itself. Each variant becomes a hashed key; grouping by key
finds the earliest line of each key, which every other line of the key is compared with. That
is as good as comparing all pairs: lines that share (variant, p) are all alike, and a line is
dropped if any earlier line is like it.

Variants are made only for lines that share their first or last half with another line,
which any two alike lines do: of n units, keys of floor(n / 2) and floor((n + 1) / 2) units at
either end. What lines that share a first half differ in stands behind it, so only units behind the half are left out of them, and
in front of the last half likewise.

A line's place is one decimal number: its document's number, a hash of the text that tells rows with one doc_id apart, and the
number of the line. Places order the lines, and as numbers they can be aggregated by hashing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: Units of the least line that goes if it is only alike; copies go at any length.
FUZZY_UNITS = 10
#: Bits of the filter that says which documents hold suspect lines.
_BITS = 1 << 23

#: Lines of an SQL string in which blanks other than line feeds have become spaces. ``replace`` looks for bytes and needs no regex.
_LINES = "split(replace(replace(replace(replace({0}, '\t', ' '), '\x0b', ' '), '\x0c', ' '), '\r', ' '), '\n')"
#: Units of a line of these.
_UNITS = "if(octet_length({0}) > 2 * char_length({0}), regexp_extract_all({0}, '[^ ]', 0), array_remove(split({0}, ' '), ''))"


def _base() -> Column:
    """The place of a document's line 0: rows with a null doc_id come last, by a hash of their text."""
    unsigned = "cast(xxhash64(text) as decimal(20, 0)) + 9223372036854775808"
    number = f"if(doc_id is null, {unsigned} + 9223372036854775808, cast(doc_id as decimal(20, 0)))"
    tie = "cast(pmod(xxhash64(text), 1000000000) * 1000000000 as decimal(19, 0))"
    return F.expr(f"cast(cast({number} as decimal(20, 0)) * 1000000000000000000 as decimal(38, 0)) + {tie}").cast("decimal(38,0)")


def _line_number(place: str) -> str:
    return f"cast(pmod({place}, 1000000000) as int)"


def distinct_lines(docs: DataFrame, fuzzy_units: int = FUZZY_UNITS) -> DataFrame:
    """(h1, h2, place, k0 to k3): a hash of 128 bits of each distinct line, where it stands first, and the keys of its halves (null for short lines)."""
    rows = docs.select(_base().alias("base"), F.posexplode(F.expr(_LINES.format("text"))).alias("no", "line")).where("trim(line) <> ''")
    rows = rows.select(F.expr("cast(base + no as decimal(38, 0))").alias("place"), F.expr(_UNITS.format("line")).alias("units"))
    half, rest = "cast(size(units) / 2 as int)", "cast((size(units) + 1) / 2 as int)"
    keys = [f"xxhash64('head', slice(units, 1, {k}))" for k in (half, rest)] + [f"xxhash64('tail', slice(units, size(units) - {k} + 1, {k}))" for k in (half, rest)]
    hashed = rows.select("place", F.expr("xxhash64(units)").alias("h1"), F.expr("xxhash64(1L, units)").alias("h2"), *[F.expr(f"if(size(units) >= {fuzzy_units}, {k}, null)").alias(f"k{i}") for i, k in enumerate(keys)])
    return hashed.groupBy("h1", "h2").agg(F.min("place").alias("place"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)])


def one_unit_apart(a: str, b: str) -> Column:
    """Whether two arrays of units are at most one inserted, deleted or replaced unit apart."""
    return F.expr(
        f"""element_at(transform(array(array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false)), i ->
        i = 0 or slice({a}, int(i) + 1, size({a})) = slice({b}, int(i) + 1, size({b}))
        or slice({a}, int(i) + 1, size({a})) = slice({b}, greatest(int(i), 1), size({b}))
        or slice({a}, greatest(int(i), 1), size({a})) = slice({b}, int(i) + 1, size({b}))), 1)"""
    )


def suspects(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(place, units, halves): the lines that share a half with another line; halves: 1 the first, 2 the last, 3 both."""
    each = F.array_distinct(F.array(*[F.struct(F.col(f"k{i}").alias("key"), F.lit(half).alias("half")) for i, half in enumerate((1, 1, 2, 2))]))
    keyed = lines.where("k0 is not null").select("place", F.explode(each).alias("x")).select("place", "x.key", "x.half")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    some = keyed.join(shared, "key", "left_semi").groupBy("place").agg(F.bit_or("half").alias("halves"))
    number = F.expr(_line_number("place"))
    wanted = some.groupBy((F.col("place") - number).cast("decimal(38,0)").alias("of")).agg(F.collect_list(F.struct(number.alias("no"), "halves")).alias("those"))
    wanted = written(wanted, "wanted-lines")
    # At most _BITS / 64 rows, however many documents: a filter before the shuffle that may let others pass.
    bit = f"cast(pmod({{0}}, 1000000000000000000) as bigint) div 1000000000 % {_BITS}"
    word, mask = lambda c: F.expr(f"cast(({bit.format(c)}) div 64 as int)"), lambda c: F.expr(f"shiftleft(1L, cast(({bit.format(c)}) % 64 as int))")
    bits = wanted.groupBy(word("of").alias("word")).agg(F.bit_or(mask("of")).alias("mask"))
    texts = docs.select(_base().alias("base"), "text").withColumn("word", word("base")).join(F.broadcast(bits), "word").where(F.col("mask").bitwiseAND(mask("base")) != 0)
    found = F.expr(
        f"""element_at(transform(array({_LINES.format("text")}), l -> transform(those, w ->
            struct(of + w.no as place, {_UNITS.format("element_at(l, w.no + 1)")} as units, w.halves as halves))), 1)"""
    )
    rows = texts.join(wanted, F.col("base") == F.col("of")).select(F.explode(found).alias("w"))
    return rows.select(F.col("w.place").cast("decimal(38,0)").alias("place"), "w.units", "w.halves").dropDuplicates(["place"])


def variants(lines: DataFrame) -> DataFrame:
    """(place, p, variant) for p = 0 (the whole line) and each unit p outside of the shared half of every line of ``lines`` (place, units, halves).

    A line's hash is the exclusive or of the hashes of (unit, number); without unit p it is that of the units before p and of those
    after p with numbers less by 1. Both come from sums over whole steps of about the root of the number of units and over the rest
    of a step, so that the work grows with the power 1.5 of the units.
    """
    half = "cast(size(units) / 2 as int)"
    span = {"low": F.expr(f"if(halves = 1, {half} + 1, 1)"), "high": F.expr(f"if(halves = 2, size(units) - {half}, size(units))")}
    rows = lines.withColumns(span).select("place", "low", "high", F.expr("transform(units, (u, i) -> struct(xxhash64(u, i) as here, xxhash64(u, i - 1) as moved))").alias("x"))
    rows = rows.withColumn("step", F.expr("greatest(cast(sqrt(size(x)) as int), 1)"))
    folded = "aggregate({0}, struct(0L as here, 0L as moved), (s, v) -> struct(s.here ^ v.here as here, s.moved ^ v.moved as moved))"
    # sums[k] is over the first k steps.
    rows = rows.withColumn("steps", F.expr(f"transform(sequence(0, size(x) div step), k -> {folded.format('slice(x, int(k * step) + 1, step)')})"))
    rows = rows.withColumn("sums", F.expr(f"transform(sequence(0, size(x) div step), k -> {folded.format('slice(steps, 1, int(k))')})"))
    rows = rows.withColumn("all", F.expr(folded.format("steps")))
    before = "element_at(sums, int((p - 1) div step) + 1).{1} ^ aggregate(slice(x, int((p - 1) div step * step) + 1, int({0} - (p - 1) div step * step)), 0L, (s, v) -> s ^ v.{1})"
    each = f"transform(concat(array(0), sequence(low, high)), p -> struct(p as p, if(p = 0, all.here, {before.format('(p - 1)', 'here')} ^ all.moved ^ {before.format('p', 'moved')}) as variant))"
    return rows.select("place", F.explode(F.expr(each)).alias("v")).select("place", "v.p", "v.variant")


def near_repeats(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(place): the lines to which an earlier line is alike."""
    fuzzy = written(suspects(docs, lines), "suspect-lines")
    every = variants(fuzzy)
    by_p = every.groupBy("variant", "p").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    # A variant comes from no more p than its lines have units.
    same = W.partitionBy("variant")
    whole = F.min(F.when(F.col("p") == 0, F.col("first"))).over(same)
    earliest = F.when(F.col("p") == 0, F.min("first").over(same)).otherwise(F.least(F.col("first"), whole))
    firsts = by_p.withColumn("earliest", earliest).where((F.col("n") > 1) | (F.col("earliest") < F.col("first"))).select("variant", "p", "earliest")
    pairs = every.join(firsts, ["variant", "p"]).where(F.col("place") > F.col("earliest")).select("place", "earliest").distinct()
    a = fuzzy.select("place", F.col("units").alias("a"))
    b = fuzzy.select(F.col("place").alias("earliest"), F.col("units").alias("b"))
    return pairs.join(a, "place").join(b, "earliest").where(one_unit_apart("a", "b")).select("place").distinct()


def dedup_lines(docs: DataFrame, fuzzy_units: int = FUZZY_UNITS) -> DataFrame:
    """Every row of ``docs`` with its text without repeated lines, and ld_n_lines, ld_n_kept.

    A line stays where it stands first in order of doc_id (null last) and line number, unless an
    earlier line is a copy or alike. A document that loses nothing keeps its text as it is; otherwise its kept
    lines are joined by line feeds, and blank lines go. ld_n_lines counts the lines that aren't blank. A null text
    stays null, with 0 lines. Rows that repeat both doc_id and text get the same result. An empty
    table gives an empty result. Columns whose names begin with ``ld_`` are replaced.
    """
    docs = docs.select([c for c in docs.columns if not c.startswith("ld_")])
    plain = docs.select("doc_id", "text")
    lines = written(distinct_lines(plain, fuzzy_units), "lines")
    kept = lines.select("place").join(near_repeats(plain, lines), "place", "left_anti")
    number = F.expr(_line_number("place"))
    kept = kept.groupBy((F.col("place") - number).cast("decimal(38,0)").alias("ld_of")).agg(F.collect_list(number).alias("ld_kept"))
    joined = docs.withColumn("ld_base", _base()).join(kept, F.col("ld_base") == F.col("ld_of"), "left")
    n_lines = F.expr(f"coalesce(size(filter({_LINES.format('text')}, x -> trim(x) <> '')), 0)")
    out = joined.withColumns({"ld_n_lines": F.greatest(n_lines, F.lit(0)).cast("long"), "ld_n_kept": F.coalesce(F.size("ld_kept"), F.lit(0)).cast("long")})
    rest = F.expr("element_at(transform(array(split(text, '\n')), l -> array_join(transform(array_sort(coalesce(ld_kept, array())), i -> element_at(l, i + 1)), '\n')), 1)")
    text = F.when(F.col("ld_n_lines") == F.col("ld_n_kept"), F.col("text")).otherwise(rest)
    return out.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], "ld_n_lines", "ld_n_kept")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("ld_n_lines").alias("n_lines"), F.col("ld_n_kept").alias("n_kept"), "text")


OP8_SQL = r"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), occ AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS no, unnest(l) AS line FROM split
), counted AS (
  SELECT *, CASE WHEN strlen(line) > 2 * length(line) THEN regexp_extract_all(line, '[^\x20\x09-\x0D]') ELSE regexp_extract_all(line, '[^\x20\x09-\x0D]+') END AS units FROM occ
), firsts AS (
  SELECT units, min(doc_id * 1000000 + no) AS place FROM counted WHERE len(units) > 0 GROUP BY units
), vars AS (
  SELECT place, p, CASE WHEN p = 0 THEN array_to_string(units, ' ') ELSE array_to_string(list_concat(units[:p - 1], units[p + 1:]), ' ') END AS v
  FROM (SELECT place, units, unnest(range(0, len(units) + 1)) AS p FROM firsts WHERE len(units) >= 10)
), by_p AS (
  SELECT v, p, min(place) AS first FROM vars GROUP BY v, p
), dominated AS (
  SELECT DISTINCT x.place FROM vars x JOIN by_p y ON x.v = y.v AND (x.p = y.p OR x.p = 0 OR y.p = 0) WHERE y.first < x.place
), kept AS (
  SELECT place FROM firsts WHERE place NOT IN (SELECT place FROM dominated)
), stays AS (
  SELECT c.doc_id, c.no, c.line, k.place IS NOT NULL AS keeps
  FROM counted c LEFT JOIN kept k ON k.place = c.doc_id * 1000000 + c.no WHERE len(c.units) > 0
), per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeps) AS n_kept,
    coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE keeps), '') AS rest FROM stays GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_kept, 0)::BIGINT AS n_kept,
  CASE WHEN coalesce(n_lines, 0) = coalesce(n_kept, 0) THEN d.text ELSE rest END AS text
FROM documents d LEFT JOIN per_doc USING (doc_id)
"""
