"""Evaluation runs: results, baselines and what got worse."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_run_id() -> str:
    """The time as a run id, e.g. 20310106T004724Z."""
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")


def run_time(text: Column) -> Column:
    """A run id's or ISO text's time in UTC; a time without a zone is UTC; null if neither."""
    compact = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+0000"), F.lit("yyyyMMdd'T'HHmmssXX"))
    return F.coalesce(compact, F.try_to_timestamp(text))


def build_results(checks: DataFrame, keys: list[str], label: str = "label", passed: str = "passed") -> DataFrame:
    """keys, passed, failed, total, score, status, failing (sorted labels) from single checks; status PASS without a failed one."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    rows = checks.groupBy(*keys).agg(
        F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_set(F.when(~ok, F.col(label)))).alias("failing")
    )
    return rows.withColumns({"score": F.coalesce(F.try_divide("passed", "total"), F.lit(0.0)), "status": F.when(F.col("failed") == 0, "PASS").otherwise("FAIL")})


def latest(results: DataFrame, key: str = "eval_id", run: str = "run_id") -> DataFrame:
    """Each evaluation's result with the greatest run id."""
    rest = [c for c in results.columns if c != key]
    return results.groupBy(key).agg(F.max_by(F.struct(*rest), run).alias("_r")).select(key, "_r.*").select(*results.columns)


def known_ids(results: DataFrame, baselines: DataFrame, key: str = "eval_id") -> DataFrame:
    """Sorted ids of evaluations that have a result or a baseline."""
    return results.select(key).union(baselines.select(key)).distinct().orderBy(key)


def select_tier(evals: DataFrame, tier: int, simulated: bool = False) -> DataFrame:
    """Evaluations up to a tier, without simulated ones unless asked for."""
    chosen = evals.where(F.col("tier") <= tier)
    return chosen if simulated else chosen.where(~F.coalesce("simulated", F.lit(False)))


def compare(current: DataFrame, baseline: DataFrame, key: str = "eval_id", score_tolerance: float = 0.05, duration_tolerance: float = 0.5) -> DataFrame:
    """key, score_delta, duration_ratio, regressed_checks, improved_checks, reason, regressed of results against their baseline.

    Worse is a score that fell by more than the tolerance, a duration that grew
    by more than its tolerance over a baseline of more than 0.05 s, or a check
    that fails newly. Both tables have score, duration_s and failing. Results
    without a baseline come out with nulls and are not regressed.
    """
    b = baseline.select(key, F.col("score").alias("_score"), F.coalesce("duration_s", F.lit(0.0)).alias("_duration"), F.coalesce("failing", F.array().cast("array<string>")).alias("_failing"))
    j = current.join(b, key, "left")
    fail = F.coalesce("failing", F.array().cast("array<string>"))
    delta = F.col("score") - F.col("_score")
    ratio = F.when(F.col("_duration") > 0, F.coalesce("duration_s", F.lit(0.0)) / F.col("_duration")).when(F.col("_score").isNotNull(), 1.0)
    j = j.withColumns({"score_delta": delta, "duration_ratio": ratio, "regressed_checks": F.array_sort(F.array_except(fail, "_failing")), "improved_checks": F.array_sort(F.array_except("_failing", fail))})
    worse = F.coalesce(F.col("score_delta") < -score_tolerance, F.lit(False))
    slower = F.coalesce((F.col("_duration") > 0.05) & (F.col("duration_ratio") > 1 + duration_tolerance), F.lit(False))
    broken = F.col("_score").isNotNull() & (F.size("regressed_checks") > 0)
    reasons = [
        F.when(worse, F.format_string("score dropped %.1f%% -> %.1f%%", F.col("_score") * 100, F.col("score") * 100)),
        F.when(slower, F.format_string("duration grew %.2fs -> %.2fs", F.col("_duration"), F.col("duration_s"))),
        F.when(broken, F.concat(F.size("regressed_checks").cast("string"), F.lit(" check(s) newly failing: "), F.array_join("regressed_checks", ", "))),
    ]
    return j.select(key, "score_delta", "duration_ratio", "regressed_checks", "improved_checks", F.nullif(F.concat_ws("; ", *reasons), F.lit("")).alias("reason"), (worse | slower | broken).alias("regressed"))


def status_checks(responses: DataFrame, label: str = "label", status: str = "status", expected: str = "expected", text: str = "text") -> DataFrame:
    """label, passed and detail of answers: whether the status is one of those expected, and what was said if not.

    ``expected`` is an array of statuses. A null status passes nowhere. The
    rows are what :func:`build_results` counts.
    """
    passed = F.coalesce(F.array_contains(F.col(expected), F.col(status)), F.lit(False))
    wanted = F.array_join(F.transform(F.array_sort(F.col(expected)), lambda s: s.cast("string")), " or ")
    detail = F.concat(F.lit("expected "), F.coalesce(wanted, F.lit("nothing")), F.lit(", got "), F.coalesce(F.col(status).cast("string"), F.lit("none")), F.lit(": "), F.substring(F.coalesce(F.col(text), F.lit("")), 1, 200))
    return responses.select(F.col(label).alias("label"), passed.alias("passed"), F.when(~passed, detail).alias("detail"))


def git_state(folder: str) -> tuple[str | None, str | None, bool | None]:
    """(commit, branch, whether there are changes) of a working copy; nulls where there is none."""
    import subprocess

    def ask(*words: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, timeout=30)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    changes = ask("status", "--porcelain")
    return ask("rev-parse", "HEAD"), ask("rev-parse", "--abbrev-ref", "HEAD"), None if changes is None else bool(changes)


def memory_gb() -> float | None:
    """Memory of the machine the driver runs on, if the system tells."""
    import os

    try:
        return round(os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / (1 << 30), 2)
    except (ValueError, OSError, AttributeError):
        return None


def snapshot(spark, folder: str = ".") -> DataFrame:
    """One row: :func:`environment`, the working copy's state, processors and memory of the driver's machine."""
    import os

    row = (*git_state(folder), os.cpu_count(), memory_gb())
    return environment(spark).crossJoin(spark.createDataFrame([row], "commit STRING, branch STRING, changed BOOLEAN, processors INT, memory_gb DOUBLE"))  # one row each


def environment(spark) -> DataFrame:
    """One row about where a run took place: versions, platform, cores, time."""
    import platform

    row = (spark.version, platform.python_version(), platform.system(), platform.machine(), spark.sparkContext.defaultParallelism, new_run_id())
    return spark.createDataFrame([row], "spark STRING, python STRING, system STRING, machine STRING, parallelism INT, run_id STRING")
