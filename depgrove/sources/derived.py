"""Graphs, signals and documents that Spark derives from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depgrove.functions.text import title
from depgrove.session import table


#: Rows that a task gets at most on average where a table is dealt out by a key.
ROWS = 500_000


def parts(spark: SparkSession, n: int) -> int | None:
    """Tasks for about ``n`` rows where the session's number of partitions would give each over ``ROWS`` rows, else none."""
    needed = -(-n // ROWS)
    return needed if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` of about ``n`` rows by keys, on more tasks where the session's number of partitions would give each over ``ROWS`` rows."""
    needed = parts(df.sparkSession, n)
    return df.repartition(needed, *keys) if needed else df


def part_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """``src, dst``: keys of consecutive parts inside an order, a row for each time, and the number of rows that they come from."""
    # of equal line numbers and parts the order changes nothing, so no other column is moved
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    n = rows.count()  # from the footers
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = dealt(rows, n, "l_orderkey").withColumn("next", F.lead("l_partkey").over(order)).where(F.col("next").isNotNull() & (F.col("next") != F.col("l_partkey")))
    return pairs.select(F.col("l_partkey").alias("src"), F.col("next").alias("dst")), n


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive parts inside an order; more orders make an edge more certain."""
    pairs, n = part_pairs(spark, sf_dir)
    counted = dealt(pairs, n, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    named = counted.select(F.concat(F.lit("part-"), F.col("src")).alias("src"), F.concat(F.lit("part-"), F.col("dst")).alias("dst"), "n")
    return named.withColumns({"type": F.lit("depends-on"), "confidence": F.round(1 - F.pow(F.lit(0.5), F.col("n")), 6), "source_type": F.when(F.col("n") > 1, "both").otherwise("markdown")})


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between event types of a user, a small graph with cycles."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    pairs = rows.withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("next != event_type")
    counted = pairs.groupBy(F.col("event_type").alias("src"), F.col("next").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("src"))
    return counted.withColumn("confidence", F.round(0.5 + 0.5 * F.col("n") / total, 6)).withColumn("type", F.lit("calls"))


def customer_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst``: the customers of a nation in a ring, and its suppliers in a chain into the ring; the two last suppliers enter it."""
    ring = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.lead("c_custkey").over(ring).alias("next"), F.min("c_custkey").over(Window.partitionBy("c_nationkey")).alias("first"))
    name = lambda kind, key: F.concat(F.lit(f"{kind}-"), key)
    customers = c.select(name("customer", F.col("c_custkey")).alias("src"), name("customer", F.coalesce("next", "first")).alias("dst"))
    chain = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.lead("s_suppkey").over(chain).alias("next"), F.lead("s_suppkey", 2).over(chain).alias("after"))
    chained = s.where("next IS NOT NULL").select(name("supplier", F.col("s_suppkey")).alias("src"), name("supplier", F.col("next")).alias("dst"))
    doors = c.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))
    entered = s.where("after IS NULL").join(doors, "s_nationkey")
    door = F.when(F.col("next").isNull(), F.col("low")).otherwise(F.col("high"))
    return customers.unionByName(chained).unionByName(entered.select(name("supplier", F.col("s_suppkey")).alias("src"), name("customer", door).alias("dst")))


def entity_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations, suppliers and customers as a layered graph; the table gives the component type."""
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    name = lambda kind, key: F.concat(F.lit(f"{kind}-"), F.col(key))
    nodes = nation.select(name("nation", "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.lit("gateway").alias("component_type"))
    nodes = nodes.unionByName(supplier.select(name("supplier", "s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("database").alias("component_type")))
    nodes = nodes.unionByName(customer.select(name("customer", "c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("service").alias("component_type")))
    edge = lambda df, a, b, score: df.select(a.alias("src"), b.alias("dst"), F.lit("references").alias("type"), score.alias("confidence"))
    scored = lambda c: F.round(0.4 + (F.pmod(F.floor(F.abs(F.col(c))), F.lit(60)) / 100), 6)
    edges = edge(supplier, name("supplier", "s_suppkey"), name("nation", "s_nationkey"), scored("s_acctbal"))
    return nodes, edges.unionByName(edge(customer, name("customer", "c_custkey"), name("nation", "c_nationkey"), scored("c_acctbal")))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and their parts: the return flag is the algorithm, the discount the confidence."""
    rows = table(spark, sf_dir, "lineitem")
    algorithm = F.when(F.col("l_returnflag") == "A", "code").when(F.col("l_returnflag") == "R", "structural").otherwise("cooccurrence")
    return rows.select(
        F.concat(F.lit("supplier-"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("part-"), F.col("l_partkey")).alias("dst"),
        algorithm.alias("algorithm"), F.round(0.4 + 5 * F.col("l_discount"), 6).alias("confidence"), F.when(F.col("l_linestatus") == "O", "depends-on").otherwise("calls").alias("type"),
        F.concat(F.lit("order-"), F.col("l_orderkey")).alias("evidence"), (F.col("l_tax") * 20).alias("weight"),
    )


def component_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown document for every part with edges: prose, a dependency section, links and a note."""
    pairs, n = part_pairs(spark, sf_dir)
    # two keys of each pair are moved once, to its part: counts and lists are made where they arrive; a destination occurs once, so it gives the order
    counted = dealt(pairs.repartition("src"), n, "src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.select("src", F.struct(F.concat(F.lit("part-"), "dst").alias("dst"), "n").alias("row")).groupBy("src").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    grouped = rows.select(F.concat(F.lit("part-"), "src").alias("src"), "rows")
    verb = lambda n: F.element_at(F.array(*[F.lit(v) for v in ("depends on", "calls", "uses", "reads from")]), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    item = lambda r: F.concat(F.lit("- ["), r["dst"], F.lit("](./"), r["dst"], F.lit(".md)"))
    prose = lambda r: F.concat("src", F.lit(" "), verb(r["n"]), F.lit(" "), r["dst"], F.lit("."))
    text = F.concat(F.lit("# "), "src", F.lit("\n\nOverview.\n\n## Dependencies\n\n"), F.array_join(F.transform("rows", item), "\n"), F.lit("\n\n## Notes\n\n"), F.array_join(F.transform("rows", prose), "\n"), F.lit("\n"))
    return grouped.select(F.col("src").alias("doc_id"), F.concat(F.lit("docs/"), "src", F.lit(".md")).alias("path"), text.alias("text"))


#: Documents by remainder of the key: path, lines; {0} stands for the key in five digits, {1} {-1} and so on for its neighbours.
SERVICES = {
    0: ("docs/ledger-{0}-service.md", ["# Ledger {0} Service", "", "Ledger {0} depends on the Vault {1} database.", "```", "Ledger {0} calls Vault {-3}.", "```", "It was built in 2020. The ledger calls gate {3} gateway!"]),
    1: ("docs/vault-{0}.md", ["# Vault {0} Database", "", "Vault {0} uses Relay {1} API.", "", "* Vault {0} database connects to Ledger {-1} service."]),
    2: ("docs/overview-{0}.md", ["1. Ledger {-2} Service - books", "- **Relay {0} API**: sends", "", "Provides: token-{0}, Audit {0}", "Readers require token-{0}.", "Gate {1} is forwarded to Ledger {-2}.", "- Needs the vault {-1} database at night"]),
    3: ("docs/door_{0}.md", ["# Gate {0} Gateway {#gate}", "", "Door {0} integrates with the old Ledger {-3} service today."]),
}


def service_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, title, text``: a document for every supplier, in four kinds that name one another."""
    number = lambda n: F.lpad((F.col("s_suppkey") + n).cast("string"), 5, "0")

    def filled(template: str):
        out = F.lit(template)
        for n in (0, 1, 3, -1, -2, -3):
            out = F.replace(out, F.lit("{" + str(n) + "}"), number(n))
        return out

    kind = F.pmod("s_suppkey", F.lit(4))
    path = F.coalesce(*[F.when(kind == m, filled(p)) for m, (p, _) in SERVICES.items()])
    text = F.coalesce(*[F.when(kind == m, filled("\n".join(lines))) for m, (_, lines) in SERVICES.items()])
    return table(spark, sf_dir, "supplier").select(path.alias("path"), text.alias("text")).withColumn("title", title(F.col("text"), F.col("path")))


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connection string for every supplier and customer."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("src"), F.col("s_suppkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer-"), "c_custkey").alias("src"), F.col("c_custkey").alias("k"))
    every = s.unionByName(c)
    n = F.pmod("k", F.lit(5))
    value = (
        F.when(n == 0, F.concat(F.lit("postgres://app:pw@db-"), "k", F.lit(".internal:5432/app")))
        .when(n == 1, F.concat(F.lit("redis://cache-"), "k", F.lit(":6379/0")))
        .when(n == 2, F.concat(F.lit("user:pw@tcp(mysql-"), "k", F.lit(":3306)/app")))
        .when(n == 3, F.concat(F.lit("host=pg-"), "k", F.lit(" port=5432 dbname=app")))
        .otherwise(F.concat(F.lit("queue-"), "k", F.lit(":9092")))
    )
    return every.select("src", value.alias("value"))


#: Source files by remainder of the key: name, lines; {k} stands for the key.
SOURCES = {
    0: [("app.py", [
        "import os, redis as cache", 'import requests  # requests.get("http://nowhere-{k}")', "", "# GET /v1/items/{k}", '# cache.Redis(host="old-{k}")', "client = cache.Redis(", '    host="cache-{k}",',
        "    port=6379,", ")", "note = \"requests.post('http://quoted-{k}')\"", "r = requests.get(", '    "http://api-{k}:8080/v1",', ")", 'url = os.environ["SERVICE_{k}_URL"]',
        '"""requests.get("http://doc-{k}") depends on billing-{k}-api"""', "",
    ])],
    1: [("main.go", [
        "package main", "", "import (", '\tpg "database/sql"', '\t"net/http"', '\t"github.com/redis/go-redis/v9"', ")", "", "// GET /v1/items/{k}", "// TODO: move to ledger-{k}-service", "func Open(name string) {",
        '\tdb, _ := pg.Open("postgres", "postgres://app@db-{k}:5432/app")', '\tother, _ := pg.Open("mysql", dsn)', '\tc := redis.NewClient(&redis.Options{Addr: "kv-{k}:6379"})',
        '\treq, _ := http.NewRequest("GET", "http://api-{k}/v1", nil)', '\ttext := `http.Get("http://raw-{k}")`', '\turl := os.Getenv("SERVICE_{k}_URL")', '\tslack := os.Getenv("SLACK_TOKEN")', "}", "",
    ])],
    2: [("index.ts", [
        "import axios, { get as fetchJson } from 'axios'", "import * as pg from 'pg'", "const { Kafka } = require('kafkajs')", "", "// GET /v1/items/{k} uses axios.get", "/* new pg.Pool('postgres://dead-{k}') */",
        "const pool = new pg.Pool({ connectionString: process.env.DB_{k}_URL })", "const text = `axios.get('http://template-{k}')`", "await axios", "  .get('http://api-{k}:8080/v1')",
        "await fetchJson('http://named-{k}/v1')", "const k = new Kafka({ brokers: ['broker-{k}:9092'] })", "await fetch('http://plain-{k}/x')", "",
    ])],
    3: [("web.py", [
        "from flask import Flask", "from kafka import (", "    KafkaProducer as Producer,  # writes to audit-{k}", "    KafkaConsumer,", ")", "import pika", "", "app = Flask(__name__)", "", '@app.route("/v1/items/{k}")',
        "def get(x):", "    return x", "", '@app.post("/v1")', "def make(x):", '    producer = Producer(bootstrap_servers="broker-{k}:9092")',
        '    return pika.BlockingConnection(pika.ConnectionParameters("rabbit-{k}"))', "", 'consumer = KafkaConsumer("topic", bootstrap_servers=["late-{k}:9092"])', 'queue = boto3.client("sqs")', "",
    ])],
    4: [("server.go", [
        "package main", 'import "net/http"', 'import amqp "github.com/rabbitmq/amqp091-go"', '/* http.Get("http://gone-{k}")', " * reads from store-{k}.main", " */", "func main() {",
        '\tconn, _ := amqp.Dial("amqp://mq-{k}:5672")', '\thttp.Get("http://" + host)', '\thttp.ListenAndServe(":8080", nil) // talks to the peer-{k}', "}", "",
    ]), ("go.mod", [
        "module example/server", "require github.com/redis/go-redis/v9 v9.0.{k}", "require (", "\tgithub.com/aws/aws-sdk-go-v2 v1.0.0", "\tgithub.com/aws/aws-sdk-go-v2/service/s3 v1.2.0 // the bucket",
        "\tgithub.com/lib/pq v1.10.0 // indirect", "\tgithub.com/jackc/pgx/v5 v5.1.0", "\tgithub.com/redis/go-redis/extra v9.0.0", ")", "replace (", "\tgithub.com/nats-io/nats.go v1.0.0 => ../nats", ")", "exclude github.com/IBM/sarama v1.0.0", "",
    ])],
    5: [("worker.js", [
        "const axios = require('axios')", "const { createClient, Pool: Db } = require('redis')", "const { MongoClient } = await import('mongodb')", "/**", " * connects to grid-{k}", " */",
        "axios.post(\"http://hook-{k}/x\", { url: 'http://inner-{k}' })", 'const c = createClient({ url: "redis://kv-{k}:6379" })', 'const m = new MongoClient("mongodb://docs-{k}:27017")',
        "client.fetch('http://no-{k}')", 'const e = process.env["KAFKA_BROKERS"]', "",
    ]), ("worker.test.js", ["const axios = require('axios')", "axios.get('http://tested-{k}')"])],
    6: [("main.tf", [
        '# resource "aws_sqs_queue" "ghost" {', 'resource "aws_db_instance" "orders_{k}" {', '  name = "orders"', "  depends_on = [", "    aws_sns_topic.events,", "  ]", "}", "", 'module "bucket" {',
        '  source = "terraform-aws-modules/s3-bucket/aws"', "}", 'data "aws_elasticache_cluster" "shared"', "{", '  tags = { owner = "${aws_lambda_function.worker.arn}" }', "}",
        'resource "aws_elasticache_replication_group" "sessions" {', "  parent = aws_elasticache_replication_group.sessions.id", "  queue  = aws_sqs_queue.jobs.arn", "}", 'module "custom" {', '  source = "./modules/custom"', "}", "",
    ]), ("prod.tfvars", ['db_host = "orders-{k}.internal:5432"', '# skip = "redis://x:1"', 'cache = "redis://sessions-{k}:6379"']), ("svc.py", [
        "import redis", "import psycopg2", 'a = redis.Redis(host="sessions-{k}")', 'b = psycopg2.connect("postgres://u@orders-db:5432/x")',
    ])],
    7: [("main.tf", [
        'resource "aws_sqs_queue" "alpha" {}', 'resource "aws_sqs_queue" "beta" {}', 'resource "aws_msk_cluster" "stream" {', "}", 'resource "aws_lambda_function" "report" {', "}",
    ]), ("svc.py", [
        "import boto3, requests", "from kafka import KafkaProducer", 'KafkaProducer(bootstrap_servers="broker-{k}:9092")', 'boto3.client("sqs", region_name="eu")', 'requests.get("http://lambda-worker-node/run")',
    ])],
}


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, path, content``: source, test and configuration files for every supplier and customer, in eight shapes."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("src"), F.col("s_suppkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer-"), "c_custkey").alias("src"), F.col("c_custkey").alias("k"))
    shapes = F.create_map(*[x for m, files in SOURCES.items() for x in (F.lit(m), F.array(*[F.struct(F.lit(name).alias("name"), F.lit("\n".join(lines)).alias("text")) for name, lines in files]))])
    # the keys are few bytes in few files, what is made of them is not
    keys = s.unionByName(c).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src")
    rows = keys.select("src", F.col("k").cast("string").alias("k"), F.explode(shapes[F.pmod("k", F.lit(8)).cast("int")]).alias("file"))
    return rows.select("src", F.concat_ws("/", "src", "file.name").alias("path"), F.replace("file.text", F.lit("{k}"), F.col("k")).alias("content"))
