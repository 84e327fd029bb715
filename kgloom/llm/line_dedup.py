"""Line dedup over a log-template tree, in DataFrame functions only.

A line's tokens are its words; a token that holds a digit, a web address or a mail address is a variable field at once.
The tree has fixed depth: a line goes down by its token count, by its first and its second token, and by the four equal
runs that the rest of its tokens is cut into. At each of these levels below the count there is the branch <*> beside the
token's own, for fields that vary: a line fits its literal template, those that take <*> at one level, and those that
take it at both leading tokens or at two runs. So lines that agree but in one or two places, whatever stands there, meet
in a template; one with <*> for a part must have at least `least_constant` constant tokens, and half of all.

Each line takes the template that most documents have, then the one with most constants, then with <*> furthest up. A template that at least
`min_docs` documents have taken is boilerplate: it is dropped wherever it recurs, but for the document with the smallest
doc_id, which keeps its lines. As each line has one template, what is dropped has a line of its template that stays.

Templates are told apart by their parts' 64-bit hashes, token count and place of <*> together, kept as 128 bits. Only
hashes are shuffled by template, folded to one row a distinct line first; lines that share no leading tokens with a run,
nor all runs, with another line fit no template with one and skip the search. Templates with over a two-thousandth of all rows are broadcast (at most 2,000 of them),
so no template fills a task. Texts move once, to meet what they must drop.

Defined results: a null text has no lines and stays null; an empty text is one blank line; blank lines (no tokens) have
no template and always stay; a document whose every line is dropped has the text ''. Documents are rows: repeated rows
count each, but a template that only one doc_id has is no boilerplate, and all rows of the smallest doc_id keep it; null
doc_ids never keep a template that a named one has; an empty table gives an empty result; other columns are kept, those
called n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import documents, forget, join_hot, text_or_empty, written

MIN_DOCS = 3
LEAST_CONSTANT = 4
_RUNS = 4
_PARTS = _RUNS + 2
#: The parts (first token, second token, four runs) that a template has as <*>.
_MASKS = ((), (0,), (1,), (2,), (3,), (4,), (5,), (0, 1), (2, 3), (4, 5), (2, 4), (2, 5), (3, 4), (3, 5))
#: Parts of which each template leaves all of some row constant: lines that meet in a template share one of these.
_SHARED = ((0, 1, 2), (0, 1, 3), (0, 1, 4), (2, 3, 4, 5))
_BITS = 21  # of a part's number of variable tokens
_UNTIDY = r"[\x09\x0B-\x0D]|  | \n|\n "
_FIELD = r"[0-9@]|://"


def lines_of(text: Column) -> Column:
    """Each line's text, as it stands."""
    return F.split(text, "\n")


def general_lines(text: Column) -> Column:
    """Each line with single blanks between its tokens and <*> for variable fields."""
    tidy = F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), r" ?\n ?", "\n")
    lines = F.split(F.trim(F.when(text.rlike(_UNTIDY), tidy).otherwise(text)), "\n")
    return F.transform(lines, lambda x: F.when(x.rlike(_FIELD), F.regexp_replace(x, f"[^ ]*(?:{_FIELD})[^ ]*", "<*>")).otherwise(x))


def _name(line: Column) -> Column:
    return F.xxhash64(F.lit(1), line)


def _sizes() -> list[Column]:
    """The numbers of tokens of a line's parts, from that of all, n."""
    rest = F.greatest(F.col("n") - 2, F.lit(0))
    edge = [F.floor(rest * k / _RUNS).cast("int") for k in range(_RUNS + 1)]
    return [F.least("n", F.lit(1)), F.least(F.greatest(F.col("n") - 1, F.lit(0)), F.lit(1)), *[y - x for x, y in itertools.pairwise(edge)]]


def _left(mask: tuple[int, ...]) -> Column:
    """How many constant tokens a line has outside a template's <*>."""
    own = [(F.shiftright(F.col(f"v{k // 3}"), _BITS * (k % 3))).bitwiseAND(F.lit((1 << _BITS) - 1)) for k in range(_PARTS)]
    sizes = _sizes()
    return sum((sizes[k] - own[k] for k in range(_PARTS) if k not in mask), F.lit(0)).cast("int")


def _template(mask: tuple[int, ...]) -> Column:
    """A line's template with these parts as <*>: 128 bits, its number of constant tokens, how many parts are <*> and which."""
    name = F.lit(sum(1 << k for k in mask))
    at = [F.col(f"h{k}") for k in range(_PARTS) if k not in mask]
    both = [F.col("a"), F.col("b")] if not mask else [F.xxhash64(F.lit(k), name, "n", *at) for k in (1, 2)]
    return F.struct(both[0].alias("a"), both[1].alias("b"), _left(mask).alias("left"), F.lit(len(mask)).alias("masked"), name.alias("mask"))


def _allowed(mask: tuple[int, ...], least_constant: int) -> Column:
    return F.lit(True) if not mask else (_left(mask) >= least_constant) & (_left(mask) * 2 >= F.col("n"))


def _recurs(min_docs: int) -> Column:
    many = ~F.col("first").eqNullSafe(F.col("last")) | (F.col("first").isNotNull() & F.col("unnamed"))
    return (F.col("docs") >= min_docs) & many


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, own, a, b, n, h0.., v0, v1): each document's distinct lines that aren't blank; own is the text's hash, (a, b) the line's 128 bits, h the parts' hashes, v their numbers of variable tokens."""
    lines = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("own"), F.explode(F.array_distinct(general_lines(F.col("text")))).alias("line")).where("line <> ''")
    words = lines.select("doc_id", "own", "line", F.split("line", " ").alias("w")).withColumn("n", F.size("w"))
    begin, parts = F.lit(1), []
    for size in _sizes():
        parts.append(F.slice("w", begin, size))
        begin = begin + size
    fields = [F.when(F.contains("line", F.lit("<*>")), F.size(x) - F.size(F.array_remove(x, "<*>"))).otherwise(0).cast("long") for x in parts]
    packed = [fields[k].bitwiseOR(F.shiftleft(fields[k + 1], _BITS)).bitwiseOR(F.shiftleft(fields[k + 2], 2 * _BITS)) for k in (0, 3)]
    return words.select("doc_id", "own", _name(F.col("line")).alias("a"), F.xxhash64(F.lit(2), "line").alias("b"), "n", *[F.xxhash64(x).alias(f"h{k}") for k, x in enumerate(parts)], *[v.alias(f"v{k}") for k, v in enumerate(packed)])


def templates(found: DataFrame, min_docs: int = MIN_DOCS, least_constant: int = LEAST_CONSTANT) -> DataFrame:
    """(a, b, rows, first) for each distinct line whose template recurs: its number of rows and the doc_id that keeps the template."""
    spec = ["n", *[f"h{k}" for k in range(_PARTS)], "v0", "v1"]
    counts = [F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unnamed")]
    lines = written(found.groupBy("a", "b").agg(*counts, *[F.first(c).alias(c) for c in spec]), "line-distinct")
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), "n", *[f"h{k}" for k in row]) for i, row in enumerate(_SHARED)])).alias("key")
    # One hash names a line here: a clash only lets a line go on that needn't. Short lines have no template but their own.
    pairs = lines.where(F.col("n") > least_constant).select("a", keys)
    shared = written(pairs.groupBy("key").agg(F.count("*").alias("lines")).where("lines > 1"), "line-shared")
    able = join_hot(pairs, shared, ["key"], "lines", "met").where("met IS NOT NULL").select("a").distinct()
    some = lines.join(able, "a", "left_semi")
    kinds = F.explode(F.filter(F.array(*[F.when(_allowed(m, least_constant), _template(m)) for m in _MASKS]), lambda x: x.isNotNull()))
    own = ["docs", "first", "last", "unnamed"]
    fits = some.select("a", "b", *own, kinds.alias("t"))
    fits = written(fits.select("a", "b", *own, F.col("t.a").alias("ta"), F.col("t.b").alias("tb"), "t.left", "t.masked", "t.mask"), "line-fits")
    sizes = written(fits.groupBy("ta", "tb").agg(F.sum("docs").alias("all"), F.count("*").alias("lines")), "line-sizes")
    best = F.struct(F.col("size.all").alias("all"), F.col("left"), (-F.col("masked")).alias("literal"), (-F.col("mask")).alias("before"), F.col("ta"), F.col("tb"))
    taken = join_hot(fits, sizes, ["ta", "tb"], "lines", "size").groupBy("a", "b").agg(F.max(best).alias("best"), *[F.max(c).alias(c) for c in own])
    taken = written(taken.select("a", "b", F.col("best.ta").alias("ta"), F.col("best.tb").alias("tb"), *own), "line-taken")
    # Of the other lines only those may recur that enough documents have as they are.
    alone = lines.where(F.col("docs") >= min_docs).join(taken.select("a", "b"), ["a", "b"], "left_anti")
    chosen = written(taken.unionByName(alone.select("a", "b", F.col("a").alias("ta"), F.col("b").alias("tb"), *own)), "line-chosen")
    all_ = [F.sum("docs").alias("docs"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("unnamed").alias("unnamed"), F.count("*").alias("lines")]
    often = chosen.groupBy("ta", "tb").agg(*all_).where(_recurs(min_docs)).select("ta", "tb", "first", "lines")
    often = written(often, "line-often")
    held = join_hot(chosen.select("a", "b", "ta", "tb", "docs"), often, ["ta", "tb"], "lines", "kept").where("kept IS NOT NULL")
    known = written(held.select("a", "b", F.col("docs").alias("rows"), F.col("kept.first").alias("first")), "line-templates")
    for table in (lines, shared, fits, sizes, taken, chosen, often):
        forget(table)
    return known


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, constants: bool = False, least_constant: int = LEAST_CONSTANT) -> DataFrame:
    """(doc_id, own, dropped): for each document the names of the lines that it must drop."""
    found = written(_found(docs), "line-keys")  # worked out once, read for the counts and for the answer
    if constants:
        found = found.where(_left(()) * 2 >= F.col("n"))
    known = templates(found, min_docs, least_constant)
    gone = join_hot(found.select("a", "b", "doc_id", "own"), known, ["a", "b"], "rows", "known")
    gone = gone.where("known IS NOT NULL").where(~F.col("doc_id").eqNullSafe(F.col("known.first")))
    return gone.groupBy("doc_id", "own").agg(F.collect_set("a").alias("dropped"))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, constants: bool = False, whole: str | None = None, least_constant: int = LEAST_CONSTANT) -> DataFrame:
    """The input with `text` less the dropped lines, `n_lines` and `n_dropped`. With `constants`, lines that are mostly variable fields have no template. A column called `whole` has the full text of documents that only blanks are left of."""
    gone = recurring(docs.select("doc_id", "text"), min_docs, constants, least_constant)
    rows = docs.drop("n_lines", "n_dropped")
    # Rows travel as structs, so that no column of theirs can clash with ours.
    left = rows.select(F.struct("*").alias("row"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__own"))
    same = F.col("l.__id").eqNullSafe(F.col("g.doc_id")) & (F.col("l.__own") == F.col("g.own"))
    both = left.alias("l").join(gone.alias("g"), same, "left").select("row", "dropped")
    # A document's dropped names are dealt into lists by their last bits, so that a line is sought in a short one.
    lists = F.least(F.lit(256), F.size("dropped") / 16 + 1).cast("long")
    dealt = F.when(F.size("dropped") <= 32, F.array("dropped")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), lists - 1), lambda k: F.filter("dropped", lambda x: F.pmod(x, lists) == k)))
    both = both.withColumn("dealt", F.when(F.col("dropped").isNotNull(), dealt))
    lines = lines_of(F.col("row.text"))
    named = F.arrays_zip(lines.alias("line"), F.transform(general_lines(F.col("row.text")), lambda x: F.when(x != "", _name(x))).alias("name"))
    gone = lambda x: F.array_contains(F.element_at("dealt", (F.pmod(x["name"], F.size("dealt").cast("long")) + 1).cast("int")), x["name"])
    stays = F.transform(F.filter(named, lambda x: x["name"].isNull() | ~gone(x)), lambda x: x["line"])
    both = both.withColumn("stay", F.when(F.col("dealt").isNull(), lines).otherwise(stays))
    text = F.col("row.text")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_dropped = F.when(text.isNull(), 0).otherwise(F.size(lines) - F.size("stay")).cast("long")
    kept = F.when(F.col("dealt").isNull(), text).otherwise(F.array_join("stay", "\n"))
    columns = [kept.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in rows.columns]
    if whole:
        bare = (n_dropped > 0) & (F.length(F.trim(F.translate(kept, "\n", " "))) == 0)
        columns.append(F.when(bare, text).alias(whole))
    return both.select(*columns, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(text_or_empty(), "UTF-8"), 256).alias("kept_sha256"))


def _sql() -> str:
    """The same in DuckDB's SQL, over the parts' words instead of hashes."""
    run = lambda k: f"array_to_string(list_slice(w, 3 + floor((len(w) - 2) * {k} / 4)::INT, 2 + floor((len(w) - 2) * {k + 1} / 4)::INT), ' ')"
    cuts = ["w[1]", "w[2]", *[f"CASE WHEN len(w) > 2 THEN {run(k)} ELSE '' END" for k in range(_RUNS)]]
    fits = []
    for mask in _MASKS:
        own = ", ".join("'<*>'" if k in mask else f"coalesce(p[{k + 1}], '')" for k in range(_RUNS + 2))
        left = " - ".join(["len(list_filter(w, lambda x: x <> '<*>'))", *[f"len(list_filter(string_split(coalesce(p[{k + 1}], ''), ' '), lambda x: x NOT IN ('', '<*>')))" for k in mask]])
        fits.append(f"SELECT w, docs, first, last, [{own}] AS p, len(w) AS n, {sum(1 << k for k in mask)} AS mask, {len(mask)} AS masked, {left} AS kept FROM k")
    return rf"""
WITH x AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
y AS (SELECT doc_id, text, ls, list_transform(ls, lambda l: list_transform(list_filter(string_split(regexp_replace(l, '[\x09\x0B-\x0D]', ' ', 'g'), ' '), lambda t: t <> ''),
      lambda t: CASE WHEN regexp_matches(t, '[0-9@]|://') THEN '<*>' ELSE t END)) AS ws FROM x),
d AS (SELECT doc_id, unnest(list_distinct(ws)) AS w FROM y WHERE text IS NOT NULL),
k0 AS (SELECT w, count(*) AS docs, min(doc_id) AS first, max(doc_id) AS last FROM d WHERE len(w) > 0 GROUP BY w),
k AS (SELECT *, [{", ".join(cuts)}] AS p FROM k0),
f AS ({" UNION ALL ".join(fits)}),
g AS (SELECT *, sum(docs) OVER (PARTITION BY n, mask, p) AS everywhere FROM f WHERE masked = 0 OR (kept >= {LEAST_CONSTANT} AND kept * 2 >= n)),
b AS (SELECT w, docs, first, last, n, mask, p FROM g QUALIFY row_number() OVER (PARTITION BY w ORDER BY everywhere DESC, kept DESC, masked, mask) = 1),
c AS (SELECT w, min(first) OVER t AS first FROM b WINDOW t AS (PARTITION BY n, mask, p) QUALIFY sum(docs) OVER t >= {MIN_DOCS} AND min(first) OVER t <> max(last) OVER t),
q AS (SELECT d.doc_id, list(d.w) AS gone FROM d JOIN c USING (w) WHERE d.doc_id <> c.first GROUP BY d.doc_id),
s AS (SELECT y.doc_id, len(ls) AS n, CASE WHEN gone IS NULL THEN ls ELSE list_transform(list_filter(list_zip(ls, ws), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END AS stay FROM y LEFT JOIN q USING (doc_id))
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(n - len(stay), 0)::BIGINT AS n_dropped, sha256(coalesce(array_to_string(stay, chr(10)), '')) AS kept_sha256 FROM s"""


QUERIES = {"op7_line_dedup": op7_line_dedup}
SQL = {"op7_line_dedup": _sql()}
