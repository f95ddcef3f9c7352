"""The review of a repository as one Markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import short_number
from plumbline.operators.gates import grade
from plumbline.operators.ranking import finding_order, first_findings, listed_and_rest
from plumbline.session import cut_lineage

LISTED = 20


def claim_of(p: Column) -> Column:
    band = F.concat(short_number(p["value"]), F.lit(" and "), short_number(p["upper"]))
    bound = F.when((p["comparator"] == "between") & p["upper"].isNotNull(), band).otherwise(short_number(p["value"]))
    return F.concat(
        F.lit("`"), p["metric"], F.lit(" "), p["comparator"], F.lit(" "), bound, p["unit"],
        F.lit("` under `"), p["condition"], F.lit("`."),
    )


def settled_as(p: Column, m: Column, verdict: Column) -> Column:
    return F.when(
        m["value"].isNull(), F.concat(F.lit("**Experiment:** ran and measured nothing — "), F.coalesce(m["detail"], F.lit("")))
    ).otherwise(
        F.concat(
            F.lit("**Measured:** "), short_number(m["value"]), F.coalesce(p["unit"], F.lit("")), F.lit(" — **"),
            F.coalesce(verdict, F.lit("measured")), F.lit("**. The experiment is at `"),
            F.coalesce(m["experiment"], F.lit("")), F.lit("`."),
        )
    )


def _pieces(df: DataFrame, section: int, order: Column, text: Column) -> DataFrame:
    return df.select("repo_id", F.lit(section).alias("section"), order.cast("bigint").alias("ord"), text.alias("text"))


def _rules(title: str, section: int, found: DataFrame, repos: DataFrame, empty: str) -> DataFrame:
    """Heading and one block per rule hit; where there is none, the ``empty`` sentence or nothing."""
    block = F.concat(
        F.lit("**`"), "rule", F.lit("`** — `"), "path", F.lit(":"), F.col("line").cast("string"), F.lit("`\n\n"),
        "detail", F.lit(".\n\n*Fix:* "), "remediation", F.lit("."),
    )
    hits = _pieces(found, section, F.col("line") + 1, block)
    heads = found.select("repo_id").distinct()
    parts = hits.unionByName(_pieces(heads, section, F.lit(0), F.lit(f"## {title}")))
    if empty:
        without = repos.select("repo_id").join(heads, "repo_id", "left_anti")
        parts = parts.unionByName(_pieces(without, section, F.lit(0), F.lit(f"## {title}\n\n{empty}")))
    return parts


def document_sections(
    shares: DataFrame,
    findings: DataFrame,
    dropped: DataFrame,
    deployment: DataFrame,
    schema: DataFrame,
    dependencies: DataFrame,
    services: DataFrame | None = None,
    reading: DataFrame | None = None,
    observations: DataFrame | None = None,
    modules: DataFrame | None = None,
) -> DataFrame:
    """(repo_id, section, ord, text): the document as ordered rows, whatever its length.

    ``shares``: repo_id, read, modules, percent, usd, stopped_because, unreachable. ``findings`` carry
    a score, or ``modules`` (depth and fan_in) give it. Only the first twenty are listed and the rest counted; every withdrawal is listed.
    """
    repos = shares.select("repo_id")
    heading = _pieces(
        shares, 0, F.lit(0),
        F.concat(F.lit("# "), "repo_id", F.lit("\n\nAn engineering review, read from the repository or measured against it.")),
    )
    what = _pieces(
        shares, 1, F.lit(1_000_000),
        F.concat(
            F.col("modules").cast("string"), F.lit(" modules. "), (F.col("modules") - F.col("unreachable")).cast("string"),
            F.lit(" are reachable from an entrypoint; "), F.col("unreachable").cast("string"), F.lit(" are not."),
        ),
    ).unionByName(_pieces(shares, 1, F.lit(-1), F.lit("## What this service is")))
    if services is not None:
        row = F.concat(
            F.lit("| `"), "name", F.lit("` | `"), F.coalesce(F.nullif("source_root", F.lit("")), F.lit(".")), F.lit("` | "),
            F.coalesce(F.nullif(F.array_join("ports", ", "), F.lit("")), F.lit("-")), F.lit(" | `"),
            F.coalesce(F.nullif("command", F.lit("")), F.lit("-")), F.lit("` |"),
        )
        what = what.unionByName(_pieces(services, 1, F.col("ord"), row))
    coverage = _pieces(
        shares, 2, F.lit(0),
        F.concat(
            F.lit("## What was actually read\n\nThis review **read "), F.col("read").cast("string"), F.lit(" of "),
            F.col("modules").cast("string"), F.lit(" modules** ("), F.format_string("%.1f", "percent"), F.lit("%), spent $"),
            F.format_string("%.4f", "usd"), F.lit(", and stopped because "), "stopped_because", F.lit("."),
        ),
    )
    graded = grade(findings)
    # twenty rows per repository, read three times
    if modules is None:
        listed = cut_lineage(listed_and_rest(graded, ["repo_id"], finding_order(), LISTED))
    else:
        listed = cut_lineage(first_findings(graded, modules, LISTED))
    p, m = F.col("prediction"), F.col("measurement")
    block = F.concat_ws(
        "\n\n",
        F.concat(
            F.lit("### "), F.col("position").cast("string"), F.lit(". `"), "symbol", F.lit("` — `"), "path", F.lit(":"),
            F.col("line").cast("string"), F.lit("`"),
        ),
        F.concat(F.lit("*"), "layer", F.lit(", "), "severity", F.lit("*")),
        F.col("mechanism"),
        F.when(p.isNotNull(), F.concat(F.lit("**Testable claim:** "), claim_of(p))),
        F.when(m.isNotNull(), settled_as(p, m, F.col("verdict"))),
        F.concat(F.lit("*Fix:* "), "remediation"),
    )
    code = _pieces(listed, 7, F.col("position"), block)
    rest = listed.filter("position = 1 and rest > 0")
    code = code.unionByName(
        _pieces(rest, 7, F.lit(LISTED + 1), F.concat(F.col("rest").cast("string"), F.lit(" further findings rank below these.")))
    )
    heads = listed.filter("position = 1").select("repo_id")
    code = code.unionByName(_pieces(heads, 7, F.lit(0), F.lit("## Code"))).unionByName(
        _pieces(repos.join(heads, "repo_id", "left_anti"), 7, F.lit(0), F.lit("## Code\n\nNo code findings in the modules that were read."))
    )
    gone = _pieces(dropped, 9, F.lit(1), F.concat(F.lit("- `"), "symbol", F.lit("` — "), "reason")).unionByName(
        _pieces(dropped.select("repo_id").distinct(), 9, F.lit(0), F.lit("## Withdrawn"))
    )
    measured = graded.groupBy("repo_id").agg(F.bool_or(m.isNotNull()).alias("_m"))
    limits = _pieces(
        shares.select("repo_id").join(measured, "repo_id", "left"), 10, F.lit(0),
        F.concat(
            F.lit("## What this review cannot tell you\n\n- It read a fraction of the repository, named above.\n"),
            F.when(F.coalesce("_m", F.lit(False)), F.lit("- Claims carrying a measurement were executed; the rest are predictions."))
            .otherwise(F.lit("- Nothing here was executed.")),
        ),
    )
    parts = [
        heading, what, coverage,
        _rules("Deployment", 3, deployment, repos, ""),
        _rules("Schema", 4, schema, repos, "No schema findings."),
        _rules("Dependencies", 5, dependencies, repos, "No dependency findings."),
        code, gone, limits,
    ]
    if reading is not None:
        parts.append(_pieces(reading, 6, F.col("position"), F.concat(F.lit("- "), "package", F.lit(": "), "url")))
        parts.append(_pieces(reading.select("repo_id").distinct(), 6, F.lit(0), F.lit("## Before you upgrade")))
    if observations is not None:
        said = F.concat(F.lit("**"), "mechanism", F.lit("**\n\n"), "consequence")
        parts.append(_pieces(observations, 8, F.col("position"), said))
        parts.append(_pieces(observations.select("repo_id").distinct(), 8, F.lit(0), F.lit("## Read together")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_documents(sections: DataFrame, path: str) -> None:
    """One folder of text per repository, its rows in document order.

    Rows are ranged by repository and position, so a long document is several ordered part files and
    is never gathered into one row.
    """
    ordered = sections.repartitionByRange("repo_id", "section", "ord", "text").sortWithinPartitions(
        "repo_id", "section", "ord", "text"
    )
    ordered.select("repo_id", F.concat("text", F.lit("\n")).alias("text")).write.mode("overwrite").partitionBy("repo_id").text(path)


def review_document(sections: DataFrame, most: int = 100_000) -> DataFrame:
    """(repo_id, document) for repositories whose document has at most ``most`` rows.

    Longer ones raise instead of being cut; write those with ``write_documents``.
    """
    sizes = sections.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_n"))
    too_long = F.raise_error(F.concat(F.lit("document too long for one row: "), "repo_id")).cast("bigint")
    checked = sizes.withColumn("_n", F.when(F.col("_n") <= most, F.col("_n")).otherwise(too_long))
    rows = F.array_sort(F.collect_list(F.struct("section", "ord", "text")))
    whole = sections.join(checked, "repo_id").filter("_n > 0").groupBy("repo_id").agg(rows.alias("_rows"))
    return whole.select("repo_id", F.array_join(F.transform("_rows", lambda r: r["text"]), "\n\n").alias("document"))
