"""How far a course is: mode, phase, whom it waits for, and whether its findings can be seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

#: Phases by number (fixed values).
PHASES = ("Intake", "Analyze", "Compose", "Layout", "Audit", "Student View", "Publish", "Observe")


def mode() -> Column:
    """The recorded mode; else ``summary`` where a written summary lies, nothing for an empty folder, and ``scratch``."""
    written = (F.coalesce("n_docx", F.lit(0)) > 0) | (F.coalesce("n_sources", F.lit(0)) > 0)
    return F.coalesce("recorded_mode", F.when(written, "summary").when(F.coalesce("n_files", F.lit(0)) > 0, "scratch"))


def gate(name: str) -> Column:
    return F.coalesce(F.try_element_at("gates", F.lit(name)), F.lit(False))


def phase() -> Column:
    """The furthest phase whose own condition holds.  Intake closes when there is a source, an inventory and a list of findings, every drawing is
    disposed of and the structure is settled; layout only when its author has seen the first unit."""
    intake = (F.coalesce("n_sources", F.lit(0)) > 0) & F.col("has_inventory") & F.col("has_findings") & (F.coalesce("undisposed", F.lit(1)) == 0) & gate("structureAnswered")
    reached = [
        intake, gate("analyzeDone") | gate("analyzeSkipped"), gate("composeDone") | gate("composeSkipped"), F.col("has_manifest") & gate("verifyMatched") & gate("unitOneAccepted"),
        gate("auditDone"), gate("reviewDone"), gate("published"),
    ]
    return F.greatest(F.lit(0), *[F.when(F.coalesce(r, F.lit(False)), k + 1).otherwise(0) for k, r in enumerate(reached)])


def waits_for(phase: Column) -> Column:
    """Whose move it is, and for what; null where it is one's own."""
    open_ = F.coalesce("open_findings", F.lit(0))
    return (
        F.when((phase == 3) & ~gate("courseShellVerified"), "author: the course itself")
        .when((phase == 3) & ~gate("unitOneAccepted"), "author: the first unit")
        .when(phase == 5, "reviewer: the course as a student")
        .when((phase == 6) & (open_ > 0), F.concat(F.lit("person: open findings "), open_.cast("string")))
        .when(phase == 6, "author: the word publish")
    )


def states(courses: DataFrame, *keys: str) -> DataFrame:
    """``keys``, mode, phase, its name and waits_for.  ``courses`` has recorded_mode, n_docx, n_sources, n_files, has_inventory, has_findings, undisposed, has_manifest,
    open_findings and ``gates`` (map of names to booleans)."""
    p = courses.withColumn("__phase", phase())
    name = F.get(F.array(*[F.lit(x) for x in PHASES]), F.col("__phase"))
    return p.select(*keys, mode().alias("mode"), F.col("__phase").alias("phase"), name.alias("name"), waits_for(F.col("__phase")).alias("waits_for"))


def findings_seen(json: str | Column) -> tuple[Column, Column]:
    """Open findings of a list (JSON), and the key that a list lies under by mistake: what is under another key than ``lines`` counts nowhere and is said."""
    fields = F.from_json(col(json), "map<string, string>")
    lines = F.from_json(F.try_element_at(fields, F.lit("lines")), "array<struct<state: string>>")
    others = F.filter(F.map_keys(fields), lambda k: (k != "lines") & F.coalesce(F.try_element_at(fields, k).rlike(r"(?s)^\[\s*[^\]\s]"), F.lit(False)))
    listed = F.coalesce(F.try_element_at(fields, F.lit("lines")).startswith("["), F.lit(False))
    count = F.coalesce(F.size(F.filter(lines, lambda x: F.coalesce(x["state"] == "open", F.lit(False)))), F.lit(0))
    empty = ~listed | (F.coalesce(F.size(lines), F.lit(0)) == 0)
    return F.when(listed & lines.isNotNull(), count).otherwise(0), F.when(empty, F.get(others, F.lit(0)))
