"""What people see of projects: lists with their work, dashboards, queues, finished annotations and their history.

All users' rows are made at once where the rules allow, so that a reader filters a table instead of asking for every user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.operators.reviews import top_per

# States of assignments and annotations, and their order in lists.
OPEN = ("assigned", "claimed", "in_progress")
FINISHED = ("submitted", "revised")
PROJECT_RANK = {"active": 0, "paused": 1, "draft": 2}
QUEUE_RANK = {"in_progress": 0, "claimed": 1}


def _rank(c: str, ranks: dict[str, int], rest: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in ranks.items() for x in p]), F.col(c)), F.lit(rest))


def work(assignments: DataFrame, tasks: DataFrame, annotations: DataFrame) -> DataFrame:
    """assignment_id, user_id, status and updated_at of assignments with project_id and turn_id of their task and ``annotation``, the state of their
    annotation or null."""
    own = assignments.select("assignment_id", "task_id", "user_id", "status", "updated_at").join(tasks.select("task_id", "project_id", "turn_id"), "task_id")
    return own.join(annotations.select("assignment_id", F.col("status").alias("annotation")), "assignment_id", "left")


def project_list(projects: DataFrame, tasks: DataFrame, rows: DataFrame, members: DataFrame, user: int, admin: bool = False) -> DataFrame:
    """A row per project that the user may see, in the list's order, with its tasks and the work (``rows``, from ``work``) that the user may see:
    of an annotator, their own.  Projects without tasks or work have zeros."""
    role = members.filter((F.col("user_id") == user) & (F.col("status") == "active")).select("project_id", "project_role")
    state, annotation = F.col("status"), F.col("annotation")
    seen = rows if admin else rows.join(role, "project_id").filter((F.col("project_role") != "annotator") | (F.col("user_id") == user))
    totals = seen.filter(~state.isin("withdrawn", "flagged")).groupBy("project_id").agg(
        F.count("*").alias("human_total"), F.count_if(state.isin("assigned", "claimed") & annotation.isNull()).alias("human_to_annotate"),
        F.count_if((state != "skipped") & (F.coalesce(annotation == "draft", F.lit(False)) | (state == "in_progress"))).alias("human_in_progress"),
        F.count_if(F.coalesce(annotation.isin(*FINISHED), F.lit(False)) | (state == "submitted")).alias("human_completed"), F.count_if(state == "skipped").alias("human_skipped"),
    )
    counted = tasks.groupBy("project_id").agg(F.count("*").alias("task_count"), F.count_if(F.col("status") == "submitted").alias("submitted_count"))
    listed = projects.join(role, "project_id", "left" if admin else "inner").join(counted, "project_id", "left").join(totals, "project_id", "left")
    listed = listed.fillna(0, [c for c in counted.columns + totals.columns if c != "project_id"])
    return listed.orderBy(_rank("status", PROJECT_RANK, 3), F.col("source_project_id").isNotNull(), F.desc("updated_at"), F.desc("project_id"))


def dashboards(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """user_id with counts of assignments in active projects, by state."""
    state = F.col("status")
    active = rows.join(projects.filter("status = 'active'").select("project_id"), "project_id", "left_semi")
    return active.groupBy("user_id").agg(
        F.count_if(state.isin(*OPEN)).alias("assigned"), F.count_if(F.col("annotation") == "draft").alias("drafts"), F.count_if(state == "submitted").alias("submitted"),
        F.count_if(state == "skipped").alias("skipped"), F.count_if(state == "flagged").alias("flagged"),
    )


def queues(rows: DataFrame, projects: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` open assignments of every user in active projects: begun ones, claimed ones, the rest; the last changed first, ties by id."""
    active = rows.filter(F.col("status").isin(*OPEN)).join(projects.filter("status = 'active'").select("project_id"), "project_id", "left_semi")
    return top_per(active, "user_id", [_rank("status", QUEUE_RANK, 3), F.desc("updated_at"), "assignment_id"], n)


def progress(rows: DataFrame) -> DataFrame:
    """Per user and project: assignments that were not withdrawn, and those submitted."""
    return rows.filter("status <> 'withdrawn'").groupBy("user_id", "project_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "submitted").alias("completed"))


def with_label(df: DataFrame, values: str) -> DataFrame:
    """Adds what a version's values (JSON) say in short: policy_label, has_policy_summary, summary_label, primary_domain, secondary_domains."""
    v = F.try_parse_json(values)
    there = lambda name: F.coalesce(F.array_contains(F.json_object_keys(values), name), F.lit(False))
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    non_policy = F.coalesce(F.try_variant_get(v, "$.is_non_policy", "boolean"), F.lit(False))
    label = (
        F.when(there("is_non_policy"), F.when(non_policy, "Non-Policy").otherwise("Policy"))
        .when(there("content_status"), F.when(text("content_status") == "substantive_policy", "Policy").otherwise("Non-Policy")).otherwise("Not applicable")
    )
    df = df.withColumn("policy_label", label).withColumn("has_policy_summary", F.col("policy_label") != "Not applicable")
    hostility = F.nullif(text("hostility_present"), F.lit(""))
    return df.withColumns({
        "summary_label": F.when(F.col("has_policy_summary"), F.col("policy_label")).when(hostility.isNotNull(), F.concat(F.lit("Hostility: "), hostility)).otherwise("Annotation"),
        "primary_domain": text("primary_australian_domain"),
        "secondary_domains": F.coalesce(F.try_variant_get(v, "$.secondary_australian_domains", "array<string>"), F.array().cast("array<string>")),
    })


def histories(annotations: DataFrame, versions: DataFrame) -> DataFrame:
    """A row per version of an annotation (annotation_id, version_id, revision, event_type, values) with its short form, and whether it is the current one."""
    own = versions.join(annotations.select("annotation_id", "assignment_id", "current_version_id"), "annotation_id")
    return with_label(own, "values").withColumn("current", F.col("version_id").eqNullSafe(F.col("current_version_id"))).drop("current_version_id")


def completed(rows: DataFrame, annotations: DataFrame, versions: DataFrame) -> DataFrame:
    """Finished annotations with their current version in short and the number of their versions.  Without a current version there is none."""
    done = annotations.filter(F.col("status").isin(*FINISHED)).select("annotation_id", "assignment_id", F.col("current_version_id").alias("version_id"))
    n = versions.groupBy("annotation_id").agg(F.count("*").alias("n_versions"))
    own = done.join(versions.select("version_id", "revision", "event_type", "values"), "version_id").join(n, "annotation_id")
    return with_label(own.join(rows.withColumnRenamed("status", "assignment_status"), "assignment_id"), "values")


def campaign_list(campaigns: DataFrame, corpora: DataFrame, runs: DataFrame) -> DataFrame:
    """Campaigns with their corpus's name and their run's public id, the newest first."""
    named = corpora.select("corpus_id", F.col("name").alias("corpus_name"))
    return campaigns.join(named, "corpus_id").join(runs.select("run_id", F.col("public_id").alias("run_public_id")), "run_id", "left").orderBy(F.desc("created_at"), F.desc("campaign_id"))


def corpus_list(corpora: DataFrame, runs: DataFrame) -> DataFrame:
    """Active corpora with the name of their current run, by name."""
    return corpora.filter("is_active").join(runs.select("run_id", "run_name"), F.col("current_run_id") == F.col("run_id"), "left").drop("run_id").orderBy("name")
