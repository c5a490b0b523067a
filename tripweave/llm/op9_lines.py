"""Line dedup by a log-template tree, in DataFrame functions only.

Lines walk a tree of fixed depth: token count, then the first ``LEADING`` tokens, with variable fields (tokens
that hold a digit) generalised to ``<*>``. In a leaf the line seen most often is the template; lines that agree with it in
at least ``AGREE`` of all token positions are generalised into it, any other line is a template of its own. A template is
dropped from every document if it recurs across *unrelated* documents: ``MIN_DOCUMENTS`` of them beside its largest
family, and no family has more than half. The family of a document is the leaf of its longest line, so copies
and near copies of one document are one family and keep their lines, while short shared lines don't make a family.

That is the rule of ``ORACLE`` and so of the registered query. It spares a line everywhere once most of its documents are
copies of one, and a line that is the longest of its documents. With ``each_family_once``, as in the pipeline, a
template is dropped if it recurs in more than ``MIN_DOCUMENTS`` families, however large one is, and a family
is named by the *other* lines: of the three longest other leaves the one second in number of documents, so that neither an edit
in a copy (a rare leaf) nor one more shared line (a frequent one) decides it.

Text moves once for the lines that must be compared (one copy of each distinct line in leaves that recur) and once for
the result; everything between is keyed by 64-bit hashes. Counts are partial before each shuffle, so a line in a third
of all documents costs a row per task, not a hot partition.

Cases: null texts stay null, empty texts and blank lines stay as they are and never recur; rows that share id and text
are one document and get the same result; documents whose lines all go keep an empty text; other columns pass
unchanged, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import discard, keep

LEADING = 3
AGREE = 0.5
MIN_DOCUMENTS = 5
NAMING = 3                 # longest other leaves that name a family

def _version() -> Column:
    return F.xxhash64("text")



def masked(line: Column) -> Column:
    """The line with every token that holds a digit generalised."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _leaf(line: Column) -> Column:
    return F.concat_ws(" ", _tokens(line).cast("string"), F.substring_index(line, " ", LEADING))


def keyed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, version, line_no, leaf, line, family, pos, longest of every line that isn't blank; no text.

    ``pos`` counts a document's lines, ``longest`` has its NAMING + 1 longest distinct leaves.
    """
    def keys(line: Column, number: Column) -> Column:
        general = masked(line)
        return F.struct(number.alias("line_no"), F.trim(line).alias("full"), F.length(general).alias("size"),
                        F.md5(_leaf(general)).alias("leaf"), F.xxhash64(general).alias("line"))

    rows = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), _version().alias("version"),
        F.filter(F.transform(F.split("text", "\n"), keys), lambda k: k.full != "").alias("keys"))
    return (rows.select("doc_id", "version", F.xxhash64(F.array_max(F.arrays_zip("keys.size", "keys.leaf"))["leaf"]).alias("family"),
                        F.transform(F.slice(F.array_distinct(F.sort_array(F.arrays_zip("keys.size", "keys.leaf"), False)["leaf"]),
                                            1, NAMING + 1), lambda x: F.xxhash64(x)).alias("longest"),
                        F.posexplode("keys").alias("pos", "k"))
            .select("doc_id", "version", "k.line_no", F.xxhash64("k.leaf").alias("leaf"), "k.line", "family", "pos",
                    "longest"))


def templates(docs: DataFrame, lines: DataFrame, agree: float = AGREE, least: int = MIN_DOCUMENTS) -> DataFrame:
    """leaf, line, template of each distinct line in a leaf with at least ``least`` lines.

    A template is named by the hash of its most frequent line.
    """
    distinct = lines.groupBy("leaf", "line").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "line_no")).alias("at"))
    leaves = distinct.groupBy("leaf").agg(F.sum("n").alias("n_leaf"), F.count("*").alias("n_distinct")) \
        .where(F.col("n_leaf") >= least)
    known = keep(distinct.join(leaves, "leaf"), "lines")
    alone = known.where("n_distinct = 1").select("leaf", "line", F.col("line").alias("template"))
    wanted = known.where("n_distinct > 1").groupBy("at.doc_id", "at.version").agg(
        F.collect_list(F.struct("leaf", "line", "n", F.col("at.line_no").alias("line_no"))).alias("wanted"))
    found = (docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"),
                                                   _version().alias("version"), "text")
             .join(wanted.hint("merge"), ["doc_id", "version"])     # the same plan at every size
             .select("doc_id", "version", F.split("text", "\n").alias("all"), F.explode("wanted").alias("w"))
             .select("w.leaf", "w.line", "w.n", masked(F.element_at("all", F.col("w.line_no") + 1)).alias("words"))
             .groupBy("leaf", "line").agg(F.max("n").alias("n"), F.min("words").alias("words")))
    found = keep(found, "words")
    first = found.groupBy("leaf").agg(
        F.min_by(F.struct("line", "words"), F.struct(-F.col("n"), "words")).alias("first"))
    same = F.size(F.filter(F.zip_with(F.split("words", " "), F.split("first.words", " "), lambda a, b: a == b),
                           lambda x: x))
    joined = found.join(first, "leaf").select(
        "leaf", "line", F.when(same >= agree * F.size(F.split("words", " ")), F.col("first.line"))
        .otherwise(F.col("line")).alias("template"))
    out = keep(alone.unionByName(joined), "templates")
    discard(known, found)
    return out


def recurring(lines: DataFrame, named: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, version, line_no of the lines whose template recurs across unrelated documents."""
    placed = keep(lines.join(named, ["leaf", "line"]).select(
        "doc_id", "version", "line_no", "leaf", "template", "family"), "placed")
    by_family = (placed.groupBy("leaf", "template", "family", "doc_id", "version").agg(F.lit(1).alias("one"))
                 .groupBy("leaf", "template", "family").agg(F.count("*").alias("n")))
    spread = by_family.groupBy("leaf", "template").agg(F.sum("n").alias("n"), F.max("n").alias("largest")) \
        .where((F.col("n") - F.col("largest") >= least) & (2 * F.col("largest") <= F.col("n")))
    spread = keep(spread.select("leaf", "template"), "spread")   # stored, so that a hot template's partition can be split
    out = keep(placed.join(spread, ["leaf", "template"]).select("doc_id", "version", "line_no"), "recurring")
    discard(placed, spread)
    return out


def recurring_in_families(lines: DataFrame, named: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, version, line_no of the lines whose template recurs in more than ``least`` families, each counted once."""
    names = keep(lines.where("pos = 0").select("doc_id", "version", F.posexplode("longest").alias("place", "name")).distinct(),
                 "names")
    spread_of = keep(names.groupBy("name").agg(F.count("*").alias("n")), "spread-of")
    ranked = names.join(spread_of, "name").groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_list(F.struct("place", "n", "name"))).alias("names"))
    other = F.slice(F.filter("names", lambda x: x["name"] != F.col("leaf")), 1, NAMING)
    order = F.sort_array(F.transform(other, lambda x: F.struct(x["n"].alias("n"), x["name"].alias("name"))), False)
    family = F.when(F.size(order) > 1, F.get(order, F.lit(1))).otherwise(F.get(order, F.lit(0)))["name"]
    placed = keep(lines.join(named, ["leaf", "line"]).select("doc_id", "version", "line_no", "leaf", "template")
                  .join(ranked.hint("merge"), ["doc_id", "version"])
                  .select("doc_id", "version", "line_no", "leaf", "template", F.coalesce(family, F.lit(0)).alias("family")),
                  "placed")
    spread = keep(placed.groupBy("leaf", "template", "family").agg(F.lit(1).alias("one"))
                  .groupBy("leaf", "template").agg(F.count("*").alias("n")).where(F.col("n") > least)
                  .select("leaf", "template"), "spread")
    out = keep(placed.join(spread, ["leaf", "template"]).select("doc_id", "version", "line_no"), "recurring")
    discard(names, spread_of, placed, spread)
    return out


def drop_recurring_lines(docs: DataFrame, agree: float = AGREE, least: int = MIN_DOCUMENTS,
                         dropped: str | None = None, each_family_once: bool = False) -> DataFrame:
    """``docs`` without the lines of recurring templates; ``dropped`` names a column for their number."""
    lines = keyed_lines(docs)
    lines = keep(lines if each_family_once else lines.drop("pos", "longest"), "keys")
    named = templates(docs, lines, agree, least)
    found = (recurring_in_families if each_family_once else recurring)(lines, named, least)
    discard(lines, named)
    gone = found.groupBy(
        F.col("doc_id").alias("_gone_doc"), F.col("version").alias("_gone_version")).agg(
        F.collect_set("line_no").alias("_gone"))
    gone = gone.hint("merge")
    joined = docs.join(gone, (docs["doc_id"].cast("long") == gone["_gone_doc"])
                       & (F.xxhash64(docs["text"]) == gone["_gone_version"]), "left")
    none = gone["_gone"].isNull()
    kept = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(gone["_gone"], i)), "\n")
    text = F.when(none, docs["text"]).otherwise(kept).alias("text")
    columns = [text if c == "text" else docs[c] for c in docs.columns]
    if dropped:
        columns.append(F.when(none, 0).otherwise(F.size(gone["_gone"])).cast("long").alias(dropped))
    return joined.select(*columns)


#: the same in SQL over the table ``documents``
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, text, i - 1 AS line_no, line,
         CASE WHEN regexp_matches(line, '[0-9]') THEN regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g')
              ELSE line END AS words
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
  WHERE trim(line, ' ') <> ''),
keyed AS (
  SELECT *, md5(concat_ws(' ', length(words) - length(replace(words, ' ', '')) + 1,
                          array_to_string(string_split(words, ' ')[1:{LEADING}], ' '))) AS leaf
  FROM lines),
families AS (
  SELECT doc_id, text, leaf AS family FROM keyed
  QUALIFY row_number() OVER (PARTITION BY doc_id, text ORDER BY length(words) DESC, leaf DESC) = 1),
counted AS (SELECT leaf, words, count(*) AS n FROM keyed GROUP BY ALL),
leaves AS (SELECT leaf FROM counted GROUP BY leaf HAVING sum(n) >= {MIN_DOCUMENTS}),
firsts AS (
  SELECT leaf, words AS first_words FROM counted
  QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY n DESC, words) = 1),
named AS (
  SELECT leaf, words,
         CASE WHEN list_sum(list_transform(list_zip(string_split(words, ' '), string_split(first_words, ' ')),
                                           lambda x: (x[1] = x[2])::INT))
                   >= {AGREE} * len(string_split(words, ' ')) THEN first_words ELSE words END AS template
  FROM counted JOIN leaves USING (leaf) JOIN firsts USING (leaf)),
placed AS (
  SELECT k.doc_id, k.text, k.line_no, k.leaf, template, family
  FROM keyed k JOIN named n ON k.leaf = n.leaf AND k.words = n.words
  JOIN families f ON k.doc_id = f.doc_id AND k.text = f.text),
by_family AS (
  SELECT leaf, template, family, count(*) AS n
  FROM (SELECT DISTINCT leaf, template, family, doc_id, text FROM placed) GROUP BY ALL),
spread AS (
  SELECT leaf, template FROM by_family GROUP BY ALL
  HAVING sum(n) - max(n) >= {MIN_DOCUMENTS} AND 2 * max(n) <= sum(n)),
gone AS (
  SELECT doc_id, text, list(DISTINCT line_no) AS gone FROM placed JOIN spread USING (leaf, template) GROUP BY ALL)
"""

ORACLE_LINES = ORACLE + """
SELECT d.doc_id,
       CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(
         list_zip(string_split(d.text, chr(10)), range(len(string_split(d.text, chr(10))))),
         lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]), chr(10)) END AS text,
       CASE WHEN gone IS NULL THEN 0 ELSE len(gone) END::BIGINT AS n_dropped
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.text = g.text
"""
