"""Whether a source outside Python reads cleanly (T01): strings and comments end, and brackets close in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import dims

LINE, BLOCK = r"//[^\n]*+", r"/\*(?s:.*?)\*/"
QUOTED = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"'
SINGLE = r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
OVER_LINES = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"'
#: What is left of an opening once nothing closes it, and the brackets.
OPENED, BRACKET = r"/\*|[\"'`]", r"[()\[\]{}]"
#: A slash that begins a pattern stands where a value may; elsewhere it divides.
PATTERN = r"(?<=(?:^|[=(,:;!&|?{}\[\n]|return)[ \t]{0,8})/(?![/*])[^/\\\n\[]*+(?:(?:\\.|\[[^\]\\\n]*+(?:\\.[^\]\\\n]*+)*+\])[^/\\\n\[]*+)*+/"
NUMBER = r"\b\d[\w']*+"

#: How a language is cut into comments, strings, brackets and what is left open, tried from left to right at each place.
TOKENS = {
    "go": "|".join((LINE, BLOCK, QUOTED, r"'(?:\\[^\n']{1,10}+|\\'|[^'\\\n])'", r"`[^`]*+`", OPENED, BRACKET)),
    "rust": "|".join((LINE, BLOCK, r'\bb?r(#{0,6})"(?s:.*?)"\1', OVER_LINES, r"'(?:\\[^\n']{1,10}+|\\'|[^'\\\n])'", r"'\w++", OPENED, BRACKET)),
    "java": "|".join((LINE, BLOCK, r'"""(?s:.*?)(?<!\\)"""', QUOTED, SINGLE, OPENED, BRACKET)),
    "cpp": "|".join((LINE, BLOCK, r"(?m:^[ \t]*#[ \t]*(?:error|warning)[^\n]*+)", r'R"([^(\s]{0,16})\((?s:.*?)\)\1"', QUOTED, NUMBER, SINGLE, OPENED, BRACKET)),
}
SCRIPT = "|".join((LINE, BLOCK, PATTERN, QUOTED, SINGLE, r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`", OPENED, BRACKET))
#: Rounds of taking out closed pairs before what is left goes by rows; each takes out one level of nesting.
ROUNDS = 16


def _tokens(language: Column, text: Column) -> Column:
    found = F.when(language.isin(*dims.UNTYPED_LANGUAGES), F.regexp_extract_all(text, F.lit(SCRIPT), F.lit(0)))
    for name, pattern in TOKENS.items():
        found = found.when(language == name, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def unclean(files: DataFrame) -> DataFrame:
    """(repo_id, path, reason) of ``files`` (repo_id, path, language, text) that do not read cleanly.

    The brackets outside strings and comments stay as one short text per file, from which closed pairs are taken out, one
    level of nesting at a time. What is left of it goes by rows: the depth after each bracket is a running sum, and a bracket
    that closes must fit the one before it at its depth. Null and empty texts, and languages without a lexical form, are clean.
    """
    cut = files.select("repo_id", "path", _tokens(F.col("language"), F.col("text")).alias("_tokens"))
    opened = F.exists("_tokens", lambda x: x.isin("/*", '"', "'", "`"))
    brackets = F.array_join(F.filter("_tokens", lambda x: x.isin(*"()[]{}")), "")
    marked = cut.select("repo_id", "path", opened.alias("_open"), brackets.alias("_left"))
    left = F.col("_left")
    for _ in range(ROUNDS):
        left = F.regexp_replace(left, r"\(\)|\[\]|\{\}", "")
    marked = marked.withColumn("_left", left)
    lost = marked.where("_open").select("repo_id", "path", F.lit("a string or comment is not closed").alias("reason"))
    rows = marked.where("not _open and _left <> ''").select("repo_id", "path", F.posexplode(F.split("_left", "")).alias("_at", "_b")).where("_b <> ''")
    opens = F.col("_b").isin("(", "[", "{")
    file = Window.partitionBy("repo_id", "path").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = rows.withColumn("_depth", F.sum(F.when(opens, 1).otherwise(-1)).over(file))
    level = deep.withColumn("_level", F.when(opens, F.col("_depth")).otherwise(F.col("_depth") + 1))
    before = F.lag("_b").over(Window.partitionBy("repo_id", "path", "_level").orderBy("_at"))
    fits = F.coalesce(F.concat(before, F.col("_b")).isin("()", "[]", "{}"), F.lit(False))
    judged = level.withColumn("_wrong", ~opens & ~fits).groupBy("repo_id", "path").agg(
        F.bool_or("_wrong").alias("_wrong"), F.max_by("_depth", "_at").alias("_end")
    )
    crossed = judged.where("_wrong or _end <> 0").select("repo_id", "path", F.lit("brackets do not close in order").alias("reason"))
    return lost.unionByName(crossed)
