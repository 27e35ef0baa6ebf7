"""Views of the driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as t

ALLOWED = ["global", "lang:en", "lang:fr", "repo:src1", "repo:src2", "repo:src3"]
NOW = "TIMESTAMP '2024-02-01 00:00:00'"
MODEL = "demo"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cards(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """documents as cards; toxic ones are retired, low-quality ones candidates.

    What a query needs of a text is cut from it before the joins, so that those shuffle no whole texts for a title.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    status = F.when(F.col("toxic") == 1, "retired").when(F.col("quality") == 0, "candidate").otherwise("active")
    scopes = F.when(F.col("doc_id") % 10 == 0, F.array(F.lit("global"))).otherwise(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("repo:"), "source")))
    docs = table(spark, sf_dir, "documents").where("text is not null").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("id"), "doc_id", F.lit("doc").alias("type"), F.substring("text", 1, 80).alias("title"),
        F.substring("text", 1, 240).alias("summary"), F.col("text").alias("body"), scopes.alias("scopes"),
        F.when(F.col("doc_id") % 7 == 0, F.concat_ws("/", "source", "lang")).otherwise("").alias("key"), F.array().cast("array<string>").alias("aliases"),
        F.slice(F.filter(t.terms(F.substring("text", 1, 80)), lambda w: F.length(w) >= 9), 1, 1).alias("trig_kw"), (F.col("doc_id") % 50 == 0).alias("baseline"),
        F.col("doc_id").alias("index_seq"), F.sha2("text", 256).alias("content_hash"), t.token_estimate(F.col("text")).alias("tok_body"),
    )
    own = docs.columns
    rows = docs.join(labels, "doc_id", "left").select(*own[: own.index("index_seq")], status.alias("status"), *own[own.index("index_seq") :])
    if vectors:
        vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
        rows = rows.join(vec, "doc_id", "left")
    return rows


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as queries, each with the vector of its number."""
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(vec, "query_id", "left")


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations as prompts."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ts"), F.coalesce("text", F.lit("")).alias("prompt"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts; every seventh assistant turn has a tool error."""
    rows = table(spark, sf_dir, "conversations")
    errors = F.when((F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 7 == 0), F.array(F.when(F.col("conv_id") % 2 == 0, "Interrupted by USER").otherwise("exit 1"))).otherwise(F.array().cast("array<string>"))
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("idx"), "role", F.coalesce("text", F.lit("")).alias("text"), errors.alias("tool_errors"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as sessions of one user, who says their lines."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("session_id"), F.lit("user").alias("role"), F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))


def injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the delivery log."""
    form = F.when(F.col("event_type").isin("click", "purchase"), "body").when(F.col("event_type") == "view", "summary").otherwise("hook")
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id", F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"),
        F.concat(F.lit("doc/"), F.get_json_object("props", "$.k")).alias("card_id"), form.alias("granularity"), F.floor("value").alias("tokens"),
        F.concat(F.lit("repo"), (F.col("user_id") % 7).cast("string")).alias("cwd"), F.when(F.col("user_id") % 2 == 0, "codex").otherwise("claude").alias("harness"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as feedback on cards."""
    kind = F.when(F.col("event") == "click", "expanded").when(F.col("event") == "purchase", "referenced").when(F.col("event") == "error", "downvoted")
    delta = F.when(F.col("event") == "click", 1.0).when(F.col("event") == "purchase", 0.5).otherwise(0.1)
    return injections(spark, sf_dir).select("session_id", "card_id", kind.alias("kind"), delta.alias("delta"), "ts").where("kind is not null")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as calls of a model."""
    return injections(spark, sf_dir).select(F.col("event_id").alias("call_id"), "ts", (F.col("tokens") / 1000.0).alias("usd"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and their lines as commits: a customer is a repository, brands are directories."""
    dirs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("dirs"))
    rows = table(spark, sf_dir, "orders").join(dirs, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("o_custkey").alias("repo"), F.col("o_orderstatus").alias("branch"), F.col("o_orderkey").cast("string").alias("sha"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("time"), "dirs")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order lines as changed files of a nation's repository."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    top = F.when(F.col("l_linenumber") % 3 == 0, "src").when(F.col("l_linenumber") % 3 == 1, "docs")
    path = F.concat_ws("/", top, F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")), F.col("l_linenumber").cast("string"))
    path = F.when(F.col("l_linenumber") == 7, "go.sum").otherwise(path)
    return li.select((F.col("l_suppkey") % 10).alias("repo"), F.col("l_orderkey").alias("sha"), F.col("l_orderkey").alias("time"), path.alias("path"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as commits with subjects; every fifth repository hardly keeps to a convention."""
    kinds = F.array(*map(F.lit, ("feat(x): ", "fix: ", "docs!: ", "chore: ", "test(a b): ", "perf: ", "ci: ", "misc ")))
    key, repo = F.col("o_orderkey"), F.col("o_custkey") % 50
    kind = F.get(kinds, F.when((repo % 5 == 0) & (key % 16 != 0), 7).otherwise(F.floor(key / 4) % 8).cast("int"))
    return table(spark, sf_dir, "orders").select(repo.alias("repo"), key.alias("sha"), F.col("o_orderdate").cast("timestamp").alias("time"), F.concat(kind, "o_orderpriority").alias("subject"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as commits of three lanes in ten repositories; the first lane merges the second now and then, the third never."""
    repo, lane = F.col("o_custkey") % 10, F.col("o_orderkey") % 3
    rows = table(spark, sf_dir, "orders").select(repo.alias("repo"), F.col("o_orderkey").alias("sha"), lane.alias("lane"), "o_orderpriority", "o_orderstatus")
    own, all_ = Window.partitionBy("repo", "lane").orderBy("sha"), Window.partitionBy("repo").orderBy("sha").rowsBetween(Window.unboundedPreceding, -1)
    other = F.when((F.col("lane") == 0) & (F.floor(F.col("sha") / 3) % 8 == 0), F.last(F.when(F.col("lane") == 1, F.col("sha")), ignorenulls=True).over(all_))
    return rows.withColumn("parents", F.array_compact(F.array(F.lag("sha").over(own), other)))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as copies of files: those that start alike are copies of one."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.concat(F.lit("repo"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("repo"), F.col("lang").alias("kind"), F.substring("text", 1, 24).alias("name"), F.col("text").alias("content"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations of style."""
    return injections(spark, sf_dir).select(F.col("cwd").alias("repo"), F.concat(F.lit(" "), F.initcap("event"), F.lit(" ")).alias("dimension"), "session_id", "ts")
