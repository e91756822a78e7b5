"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The tree is domain, language, source. A leaf can give its tokens `epochs` times. Going down, a node's budget is shared
among its children by weight; a child that can't take its share (its subtree hasn't enough tokens) gives the rest to its
siblings by weight, again and again until nothing is left over or all are full. As a node's own budget never exceeds
what its subtree can take, a shortage reaches an ancestor's other children only when no sibling has room.

Sharing among siblings is solved at once: in ascending order of capacity/weight the full children come first, and a
child is full if its capacity is at most its weight's share of what the children before it left. All arithmetic is on
whole numbers.

A leaf gives floor(budget / tokens) whole epochs, and of the next epoch the documents that come first in an order seeded
by epoch, as long as their tokens fit. The cut is one place in that order per leaf: whether a row is within needs no list
of the leaf's rows. Running totals are over small cells of that order and then over cells, so that one source may hold
any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import stash, text_or_empty

#: Target weights at each level by name; names not given have weight OTHER.
WEIGHTS = {"domain": {"d0": 3, "d1": 2, "d2": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 1}}
OTHER = 2
EPOCHS = 2
SEED = "mix-1"
#: Share of all tokens that the mix has, as a fraction.
SHARE = (1, 1)
LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of a document's order that make its cell, of 16^CELL.
CELL = 3


def domain(source: Column) -> Column:
    """A source's domain: one of three by checksum."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(source), 1, 2), 16, 10).cast("int") % 3).cast("string"))


def tokens(text: str = "text") -> Column:
    """The text's words of other characters than ASCII white space."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order(epoch: Column, seed: str = SEED) -> Column:
    """The documents' seeded order in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(OTHER)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("decimal(18,0)")


def shared_out(children: DataFrame, parents: list[str], level: str, weights: dict[str, dict[str, int]]) -> DataFrame:
    """children (parents, level, room, given: the parent's budget) with `budget` for each child."""
    w = children.withColumn("w", weight(level, weights)).filter("w > 0")
    by = Window.partitionBy(*parents, "given").orderBy(F.col("room").cast("double") / F.col("w").cast("double"), level)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("left", F.col("given") - F.coalesce(F.sum("room").over(before), F.lit(0).cast("decimal(28,0)"))).withColumn("weights", F.sum("w").over(after))
    # full: room/w <= left/weights, from the first child on without a gap
    w = w.withColumn("full", (F.col("room") * F.col("weights")).cast("decimal(38,0)") <= (F.col("w") * F.col("left")).cast("decimal(38,0)"))
    w = w.withColumn("full", F.min("full").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # The first child that isn't full fixes the share of all that aren't.
    whole = Window.partitionBy(*parents, "given")
    first = F.min(F.when(~F.col("full"), F.struct(F.col("nth"), F.col("left"), F.col("weights")))).over(whole)
    w = w.withColumn("nth", F.row_number().over(by)).withColumn("first", first)
    share = F.expr("(w * first.left) div first.weights").cast("decimal(28,0)")
    return w.withColumn("budget", F.when(F.col("full"), F.col("room")).otherwise(share)).drop("w", "left", "weights", "full", "nth", "first", "given")


def budgets(leaves: DataFrame, total: Column, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Of leaves (domain, lang, source, supply): the same with `budget`, at most epochs * supply each."""
    leaves = leaves.filter("supply > 0").withColumn("room", (F.col("supply") * epochs).cast("decimal(28,0)"))
    own = leaves
    whole = leaves.agg(F.least(total, F.sum("room")).cast("decimal(28,0)")).first()[0] or 0  # one number
    given = None
    for depth, level in enumerate(LEVELS):
        parents = list(LEVELS[:depth])
        nodes = leaves.groupBy(*parents, level).agg(F.sum("room").cast("decimal(28,0)").alias("room"))
        nodes = nodes.join(given, parents) if parents else nodes.withColumn("given", F.lit(whole).cast("decimal(28,0)"))
        given = shared_out(nodes, parents, level, weights).select(*parents, level, F.col("budget").alias("given"))
    return own.join(given.withColumnRenamed("given", "budget"), list(LEVELS)).select(*LEVELS, "supply", "budget")


def cuts(rows: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, share=SHARE) -> DataFrame:
    """Each leaf's whole epochs and the last place of its broken epoch: LEVELS, supply, budget, whole, cut (null: none)."""
    leaves = stash(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")), "mix-leaves")
    total = F.expr(f"sum(cast(supply as decimal(28,0))) * {share[0]} div {share[1]}").cast("decimal(28,0)")
    leaf = budgets(leaves, total, weights, epochs).withColumn("whole", F.expr("cast(budget div supply as int)"))
    leaf = stash(leaf.withColumn("part", (F.col("budget") - F.col("whole") * F.col("supply")).cast("long")), "mix-budgets")
    placed = rows.join(leaf.filter("part > 0").select(*LEVELS, "whole", "part"), list(LEVELS)).withColumn("place", order(F.col("whole"), seed))
    placed = placed.withColumn("cell", F.substring("place", 1, CELL))
    sums = placed.groupBy(*LEVELS, "part", "cell").agg(F.sum("n_tokens").alias("n"))
    running = Window.partitionBy(*LEVELS).orderBy("cell")
    sums = sums.withColumn("upto", F.sum("n").over(running)).withColumn("before", F.col("upto") - F.col("n"))
    # The cell in which the budget ends, and the last whole cell before it.
    broken = sums.filter("before < part and upto > part").select(*LEVELS, "cell", "before")
    within = Window.partitionBy(*LEVELS, "cell").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = placed.join(broken, [*LEVELS, "cell"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(within)).filter("upto <= part")
    done = sums.filter("upto <= part").select(*LEVELS, F.concat("cell", F.lit("g")).alias("place"))  # after all places of the cell
    cut = last.select(*LEVELS, "place").unionByName(done).groupBy(*LEVELS).agg(F.max("place").alias("cut"))
    return leaf.join(cut, list(LEVELS), "left").select(*LEVELS, "supply", F.col("budget").cast("long").alias("budget"), "whole", "cut")


def own(name: str) -> str:
    """A column's name beside those of any documents."""
    return f"graphloom {name}"


def leveled(docs: DataFrame) -> DataFrame:
    """docs with the leaf's names: null sources and languages make a leaf of their own, named ''."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select("*", domain(source).alias(own("domain")), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias(own("lang")), source.alias(own("source")))


def counted(named: DataFrame) -> DataFrame:
    """Of leveled rows: doc_id, the leaf's names and n_tokens, written once. The texts are read for this only."""
    return stash(named.select("doc_id", *[F.col(own(c)).alias(c) for c in LEVELS], tokens().alias("n_tokens")), "mix-rows")


def copies_of(whole: str, cut: str, seed: str) -> Column:
    """How many epochs of its leaf have a row."""
    return F.col(whole) + F.coalesce(order(F.col(whole), seed) <= F.col(cut), F.lit(False)).cast("int")


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, share=SHARE, copies_as: str = "copies") -> DataFrame:
    """docs' rows of the mix: all their columns and `copies_as`, how many epochs of its leaf have the row.

    A document has as many tokens as words. Rows that repeat a doc_id in a leaf have one place in the order and stand
    or fall together; documents without words have no tokens and stand if their place is before the cut. Null text,
    lang and source count as empty, null ids as one empty id. No rows in, no rows out. Other columns pass through; a column of
    docs named as copies_as needs another name there.
    """
    named = leveled(docs)
    leaf = stash(cuts(counted(named), weights, epochs, seed, share), "mix-cuts").select(*[F.col(c).alias(own(c)) for c in (*LEVELS, "whole", "cut")])
    # A row for each leaf on the right side: Spark broadcasts it if its size is small, and splits skewed leaves if not.
    joined = named.join(leaf, [own(c) for c in LEVELS])
    copies = copies_of(own("whole"), own("cut"), seed)
    return joined.filter(copies > 0).select(*docs.columns, copies.alias(copies_as))


def mixed(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, share=SHARE) -> DataFrame:
    """One row for each selected document: doc_id, domain, lang, source, n_tokens, copies. As mix(), without the texts."""
    rows = counted(leveled(docs.select("doc_id", "text", "lang", "source")))
    leaf = stash(cuts(rows, weights, epochs, seed, share), "mix-cuts").select(*LEVELS, "whole", "cut")
    joined = rows.join(leaf, list(LEVELS)).withColumn("copies", copies_of("whole", "cut", seed))
    return joined.filter("copies > 0").select("doc_id", *LEVELS, "n_tokens", "copies")


def _weight_sql(level: str) -> str:
    return f"(CASE {level} {' '.join(f"WHEN '{n}' THEN {w}" for n, w in WEIGHTS[level].items())} ELSE {OTHER} END)::HUGEINT"


def _level_sql(depth: int) -> str:
    level, up = LEVELS[depth], ", ".join(LEVELS[:depth])
    by = f"PARTITION BY {up} " if up else ""
    given = f"JOIN given{depth - 1} USING ({up})" if up else "CROSS JOIN total"
    key = f"{up + ', ' if up else ''}{level}"
    return f"""
n{depth} AS (SELECT {key}, sum(room)::HUGEINT room FROM leaves GROUP BY {key}),
a{depth} AS (SELECT n{depth}.*, given, {_weight_sql(level)} w FROM n{depth} {given}),
b{depth} AS (SELECT *, given - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT lft,
    (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT ws, row_number() OVER o nth
  FROM a{depth} WINDOW o AS ({by}ORDER BY room::DOUBLE / w::DOUBLE, {level})),
c{depth} AS (SELECT *, min(CASE WHEN room * ws <= w * lft THEN 1 ELSE 0 END) OVER ({by}ORDER BY nth) f FROM b{depth}),
d{depth} AS (SELECT *, min(CASE WHEN f = 0 THEN nth END) OVER ({by[:-1]}) k FROM c{depth}),
given{depth} AS (SELECT {", ".join("x." + c for c in LEVELS[: depth + 1])}, CASE WHEN x.f = 1 THEN x.room ELSE x.w * y.lft // y.ws END AS given
  FROM d{depth} x LEFT JOIN d{depth} y ON y.nth = x.k{"".join(f" AND y.{c} = x.{c}" for c in LEVELS[:depth])})"""


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL for mixed()'s rows."""
    return f"""
WITH rows AS (SELECT doc_id, 'd' || (('0x' || substr(md5(coalesce(source, '')), 1, 2))::INT % 3) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {documents}),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT supply, sum(n_tokens)::HUGEINT * {EPOCHS} room FROM rows GROUP BY ALL HAVING sum(n_tokens) > 0),
total AS (SELECT least(sum(supply)::HUGEINT * {SHARE[0]} // {SHARE[1]}, sum(room)::HUGEINT) given FROM leaves),
{",".join(_level_sql(d) for d in range(3))},
leaf AS (SELECT domain, lang, source, (given // supply)::INT AS whole, (given % supply)::BIGINT AS part FROM leaves JOIN given2 USING (domain, lang, source)),
placed AS (SELECT rows.*, whole, part, md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS place FROM rows JOIN leaf USING (domain, lang, source)),
running AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS upto FROM placed),
edge AS (SELECT domain, lang, source, max(place) AS cut FROM running WHERE upto <= part AND part > 0 GROUP BY ALL)
SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN place <= cut THEN 1 ELSE 0 END)::INT AS copies
FROM placed LEFT JOIN edge USING (domain, lang, source) WHERE whole + CASE WHEN place <= cut THEN 1 ELSE 0 END > 0
"""
