"""Line dedup by a log-template tree.

The tree has a fixed depth: a line goes down by its token count, then by its first tokens (tokens
with digits count as a variable). In a leaf, a token that too few documents share at its place is a
variable as well; what is left is the line's template. Templates that recur across documents are
dropped everywhere but where they first occur. A line that recurs word for word needs no evidence
for a template: fewer documents are enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed, row_key, words

#: Leading tokens in a path; a line of no more tokens has a leaf of its own, of all its tokens.
DEPTH = 3
#: Documents that make a token at its place constant, and a template recurring.
LEAST_DOCS = 10
#: Documents that must share a line of more than DEPTH words word for word, and one of over LONG words.
VERBATIM_DOCS, LONG_DOCS, LONG = 3, 2, 50
#: A recurring template's tokens are constant to this share at least.
CONSTANT = 0.5
VARIABLE = "<*>"
#: Wanted lines that are broadcast at most (about 50 bytes each); more meet their texts by a shuffle.
BROADCAST_LINES = 200_000


def _tokens(line: str, found: Column) -> Column:
    """A line's words (``found``), those with a digit replaced by the mark of a variable."""
    return F.when(F.col(line).rlike("[0-9]"), F.transform(found, lambda x: F.when(x.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(x))).otherwise(found)


def _lines(docs: DataFrame, least_tokens: int, verbatim: bool) -> DataFrame:
    """doc_id, _k1, _k2, no, leaf, line (hashes), n (tokens), var (variables) of lines with a leaf.

    With ``verbatim`` also raw, the hash of the words with their digits.
    """
    d = docs.select("doc_id", "_k1", "_k2", F.posexplode(F.split("text", "\n")).alias("no", "_line"))
    d = d.withColumn("_w", words(F.col("_line"))).where(F.size("_w") >= least_tokens)
    d = d.withColumn("_t", _tokens("_line", F.col("_w")))
    variables = F.size(F.filter("_t", lambda x: x == VARIABLE))
    path = [F.get("_t", F.lit(k)) for k in range(DEPTH)]
    raw = [F.xxhash64("_w").alias("raw")] if verbatim else []
    return d.select("doc_id", "_k1", "_k2", "no", F.xxhash64(F.size("_t"), *path).alias("leaf"), F.xxhash64("_t").alias("line"), F.size("_t").alias("n"), variables.alias("var"), *raw)


def _templates(known: DataFrame, docs: DataFrame, least_docs: int) -> DataFrame:
    """(leaf, line, template, n, var) of lines whose leaf holds several lines.

    ``known``: the distinct lines of leaves that enough documents reach. One text that has the line
    gives its tokens.
    """
    wanted = known.groupBy("first._k1", "first._k2").agg(F.collect_list(F.struct("first.no", "leaf", "line", "docs")).alias("_wanted"))
    if known.count() <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted, ["_k1", "_k2"])
    found = found.withColumn("_all", F.split("text", "\n")).select("_all", F.explode("_wanted").alias("w"))
    found = found.select("w.leaf", "w.line", "w.docs", F.get("_all", F.col("w.no")).alias("_line"))
    found = found.dropDuplicates(["leaf", "line"])  # a text may come in several rows
    placed = cut(found.select("leaf", "line", "docs", F.posexplode(_tokens("_line", words(F.col("_line")))).alias("pos", "token")))
    shared = placed.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("_df")).where((F.col("_df") >= least_docs) & (F.col("token") != VARIABLE))
    shared = cut(shared.select("leaf", "pos", "token", F.lit(True).alias("_constant")))
    marked = placed.join(shared, ["leaf", "pos", "token"], "left")
    marked = marked.groupBy("leaf", "line").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("_constant"), F.col("token")).alias("token")))).alias("_t"),
        F.count("*").cast("int").alias("n"), F.count_if(F.col("_constant").isNull()).cast("int").alias("var"),
    )
    return marked.select("leaf", "line", F.xxhash64("_t.token", F.lit("template")).alias("template"), "n", "var")


def _verbatim(lines: DataFrame, place: Column) -> DataFrame:
    """raw, _first: lines that enough documents share word for word, and where they first occur."""
    known = lines.where(F.col("n") > DEPTH).groupBy("raw", "n", "_k1", "_k2").agg(F.min(place).alias("first"))
    known = known.groupBy("raw", "n").agg(F.count("*").alias("_docs"), F.min("first").alias("_first"))
    return cut(known.where(F.col("_docs") >= F.when(F.col("n") > LONG, LONG_DOCS).otherwise(VERBATIM_DOCS)).select("raw", "_first"))


def recurring(docs: DataFrame, least_docs: int = LEAST_DOCS, short: bool = True, verbatim: bool = True) -> DataFrame:
    """_k1, _k2, drop (line numbers, sorted) for documents that lose lines.

    ``docs`` has doc_id, text, _k1, _k2. Rows that repeat (equal id and text) count as one document.
    A template's first occurrence is the one of the least doc_id (null last), then the first line.
    ``short``: lines of DEPTH tokens or fewer count too; ``verbatim``: so do lines that VERBATIM_DOCS
    (LONG_DOCS) documents share word for word.
    """
    lines = cut(_lines(docs, 1 if short else DEPTH + 1, verbatim).dropDuplicates(["_k1", "_k2", "no"]))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2", "no")
    known = lines.groupBy("leaf", "line", "n", "var", "_k1", "_k2").agg(F.min(place).alias("first"))
    known = cut(known.groupBy("leaf", "line", "n", "var").agg(F.count("*").alias("docs"), F.min("first").alias("first")))
    leaves = known.groupBy("leaf").agg(F.sum("docs").alias("_docs"), F.count("*").alias("_lines")).where(F.col("_docs") >= least_docs)
    known = cut(known.join(cut(leaves.drop("_docs")), "leaf"))
    several = _templates(known.where("_lines > 1"), docs, least_docs)
    alone = known.where("_lines = 1").select("leaf", "line", F.col("line").alias("template"), "n", "var")
    named = cut(alone.unionByName(several).join(known.select("leaf", "line", "docs", "first"), ["leaf", "line"]))
    often = named.groupBy("leaf", "template", "n", "var").agg(F.sum("docs").alias("_docs"), F.min("first").alias("_first"))
    often = often.where((F.col("_docs") >= least_docs) & (F.col("n") - F.col("var") >= CONSTANT * F.col("n")))
    gone = cut(named.join(cut(often.select("leaf", "template", "_first")), ["leaf", "template"]).select("leaf", "line", "_first"))
    hit = lines.join(gone, ["leaf", "line"]).select("_k1", "_k2", "no", "_first")
    if verbatim:
        hit = hit.unionByName(lines.join(_verbatim(lines, place), "raw").select("_k1", "_k2", "no", "_first"))
    first = (F.col("_first._k1") == F.col("_k1")) & (F.col("_first._k2") == F.col("_k2")) & (F.col("_first.no") == F.col("no"))
    return hit.where(~first).groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("no")).alias("drop"))


def drop_recurring_lines(
    docs: DataFrame, least_docs: int = LEAST_DOCS, doc_id: str = "doc_id", text: str = "text", short: bool = True, verbatim: bool = True, counted: tuple[str, str] | None = ("_n_lines", "_n_dropped"),
) -> DataFrame:
    """``docs``, all rows and columns, with ``text`` cut and two counts added: lines, dropped lines.

    ``counted`` names the counts (None: they are left out, whatever columns ``docs`` has).

    Lines are split at line feeds; those that stay are joined again, so a text that loses none is
    unchanged. A null text stays null and has no lines; an empty one has one. ``n_chars``, if
    there is such a column, follows. An empty table gives an empty result.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *row_key(F.col(doc_id), F.col(text))).where("text is not null")
    d = keyed(docs, doc_id, text).join(recurring(plain, least_docs, short, verbatim), ["_k1", "_k2"], "left")
    body = F.col(f"_doc.{text}")
    d = d.select("_doc", "drop", F.split(body, "\n").alias("_all"))
    d = d.withColumn("_stay", F.when(F.col("drop").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), "drop")))
    kept = F.when(F.col("drop").isNull(), body).otherwise(F.array_join(F.transform("_stay", lambda i: F.get("_all", i)), "\n"))
    d = d.select("_doc", kept.alias("_text"), F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("_n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("_n_dropped"))
    out = {c: F.col(f"_doc.`{c}`") for c in docs.columns}
    out[text] = F.col("_text")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_n_dropped") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    counts = [F.greatest(c, F.lit(0)).cast("long").alias(name) for c, name in zip(("_n_lines", "_n_dropped"), counted or (), strict=False)]
    return d.select(*[c.alias(name) for name, c in out.items()], *counts)
