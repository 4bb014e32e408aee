"""Note corpora, collection lines and task indexes, each row derived from one table row.

No row is grouped with others, so a hot key in a table makes no hot note.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FENCE_START, FENCE_END = "```yaml\n", "```\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts) -> Column:
    """Parts as one text; plain strings are literals, names start with ``$``."""
    columns = [
        p if isinstance(p, Column) else F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts
    ]
    return F.concat(*columns)


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per order: frontmatter, two sections with a block each, a task section.

    The second block holds a list, which is beyond flat ``key: scalar`` lines.
    """
    orders = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    extension = F.when(F.col("o_orderpriority") == "1-URGENT", ".typ").otherwise(".md")
    path = text("/notes/orders/", F.substring("day", 1, 4), "/", "$o_orderkey", extension)
    content = text(
        "---\norder_id: ", "$o_orderkey", "\nstatus: ", "$o_orderstatus", "\npriority: ", "$o_orderpriority",
        "\nodate: ", "$day", "\n---\n\n# Order ", "$o_orderkey", "\n\nPlaced by customer ", "$o_custkey", ".\n\n",
        "## Payment\n\n", FENCE_START, "kind: payment\ntotal: ", "$o_totalprice", "\n", FENCE_END, "\nPaid in full.\n\n",
        "## Delivery\n\n### Address\n\n", FENCE_START, "kind: delivery\ncustomer: ", "$o_custkey",
        "\ntags: [", F.lower("o_orderstatus"), ", note]\n", FENCE_END, "\n",
        "## Tasks\n\n- call customer ", "$o_custkey", "\n\n## Log\n\nclosed\n",
    )
    return orders.select(path.alias("_note_file"), content.alias("content"))


def line_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per line item: frontmatter and two flat blocks."""
    lines = table(spark, sf_dir, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    path = text("/notes/lines/", "$l_returnflag", "/", "$l_orderkey", "-", "$l_linenumber", ".md")
    content = text(
        "---\norder_id: ", "$l_orderkey", "\nline: ", "$l_linenumber", "\nstatus: ", "$l_linestatus",
        "\nshipped: ", "$day", "\n---\n", "# Goods\n", FENCE_START, "kind: goods\npart: ", "$l_partkey",
        "\nqty: ", "$l_quantity", "\nprice: ", "$l_extendedprice", "\n", FENCE_END, "# Terms\n", FENCE_START,
        "kind: terms\nsupplier: ", "$l_suppkey", "\nflag: ", "$l_returnflag", "\ndiscount: ", "$l_discount", "\n", FENCE_END,
    )
    return lines.select(path.alias("_note_file"), content.alias("content"))


LINE_TYPES = {
    "order_id": "bigint", "line": "bigint", "status": "string", "shipped": "date", "kind": "string", "part": "bigint",
    "qty": "double", "price": "double", "supplier": "bigint", "flag": "string", "discount": "double",
}


def prose_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per document: frontmatter and the whole text."""
    documents = table(spark, sf_dir, "documents")
    path = text("/notes/docs/", "$source", "/", "$doc_id", F.when(F.col("lang") == "en", ".md").otherwise(".typ"))
    content = text("---\ndoc: ", "$doc_id", "\nlang: ", "$lang", "\nchars: ", "$n_chars", "\n---\n\n", "$text")
    return documents.select(path.alias("_note_file"), content.alias("content"))


def header_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per customer that opens with ``key: value`` lines instead of frontmatter."""
    customer = table(spark, sf_dir, "customer")
    content = text(
        "Name: ", "$c_name", "\nAccount no: ", "$c_custkey", "\nBalance: ", "$c_acctbal", "\n\nCustomer of ", "$c_mktsegment", ".\n"
    )
    return customer.select(text("/notes/customers/", "$c_custkey", ".md").alias("_note_file"), content.alias("content"))


def customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection lines, one per customer: a member of its segment and of its nation."""
    customer = table(spark, sf_dir, "customer")
    binder = F.array("c_mktsegment", text("n", "$c_nationkey"))
    line = F.to_json(F.struct(
        F.col("c_custkey").alias("id"), binder.alias("binder"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal")
    ))
    return customer.select(
        F.lit("/notes/collections/customers.jsonl").alias("_note_file"), F.col("c_custkey").alias("_pos"), line.alias("line")
    )


def annotation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on the customers with a high balance: overrides the balance, knows no name."""
    customer = table(spark, sf_dir, "customer").filter("c_acctbal > 5000")
    content = text(
        "---\nstatus: vip\n---\n", FENCE_START, "id: ", "$c_custkey", "\nbinder: [", "$c_mktsegment", "]\nname: ~\nacctbal: ",
        "$c_nationkey", "\n", FENCE_END,
    )
    return customer.select(text("/notes/vip/", "$c_custkey", ".md").alias("_note_file"), content.alias("content"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON properties of every event as a line."""
    return table(spark, sf_dir, "events").select(
        F.lit("/notes/collections/events.jsonl").alias("_note_file"), F.col("event_id").alias("_pos"), F.col("props").alias("line")
    )


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines whose fields differ by event type, in presence and in type."""
    kind = F.col("event_type")
    line = F.to_json(F.struct(
        F.col("event_id").alias("id"),
        F.when(kind == "purchase", F.col("value")).alias("amount"),
        F.when(kind == "click", F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.when(kind == "error", F.array(kind, F.lit("e"))).alias("tags"),
    ))
    mixed = F.when(kind == "view", F.regexp_replace(line, r"\}$", ',"who":1,"ghost":null}')).otherwise(
        F.regexp_replace(line, r"\}$", ',"who":"u"}')
    )
    return table(spark, sf_dir, "events").select(
        F.lit("/notes/collections/mixed.jsonl").alias("_note_file"), F.col("event_id").alias("_pos"), mixed.alias("line")
    )


def task_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index record per conversation turn; every line of its text is a task."""
    turns = table(spark, sf_dir, "conversations")

    def tags(*pairs) -> Column:
        return F.map_from_arrays(
            F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[F.parse_json(F.lit(v)) for _, v in pairs])
        )

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    turn_tags = (
        F.when(F.col("role") == "system", tags(("done", "false")))
        .when(F.col("turn") == 3, tags(("deferred", "true")))
        .when(F.col("turn") == 2, tags(("cancelled", "null")))
        .when(F.col("role") == "assistant", tags(("waiting", '"client"'), ("today", "true"), ("n", "3")))
        .otherwise(none)
    )

    def task(line: Column, i: Column) -> Column:
        rest = F.length(line) % 5
        status = F.when(rest == 0, "x").when(rest == 1, ">").when(rest == 2, "-").when(rest == 3, "?")
        return F.struct((i + 1).alias("line"), status.alias("status"), turn_tags.alias("tags"), line.alias("task"))

    return turns.select(
        text("/notes/talks/", "$conv_id", "-", "$turn", ".md").alias("file"),
        text("Talk ", "$role").alias("project"),
        text("talk ", "$conv_id").alias("title"),
        F.transform(F.split("text", "\n"), task).alias("tasks"),
    )
