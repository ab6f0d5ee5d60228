"""Component detection and typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keywords of the component types.
KEYWORDS = {
    "service": ("service", "api", "server", "worker", "backend", "microservice", "app", "application", "rest api", "http endpoint", "graphql", "grpc service", "web service", "endpoint", "controller", "manager", "operator"),
    "database": ("database", "db", "postgres", "postgresql", "mysql", "mariadb", "mongodb", "mongo", "dynamodb", "cockroachdb", "cassandra", "couchdb", "sqlite", "rds", "aurora", "datastore", "store", "data store", "persistence", "relational", "nosql", "sql"),
    "cache": ("cache", "redis", "memcached", "memcache", "varnish", "cdn", "elasticache"),
    "queue": ("queue", "sqs", "celery", "sidekiq", "delayed-job", "bull", "beanstalkd"),
    "message-broker": ("kafka", "rabbitmq", "rabbit", "nats", "pulsar", "kinesis", "eventbridge", "event-bus", "message-broker", "broker", "event-stream", "pub/sub", "pubsub", "event streaming", "streaming platform"),
    "load-balancer": ("load-balancer", "loadbalancer", "lb", "haproxy", "envoy", "alb", "elb", "nlb", "reverse proxy", "nginx", "proxy"),
    "gateway": ("gateway", "api-gateway", "kong", "traefik", "ambassador", "ingress"),
    "storage": ("storage", "s3", "gcs", "minio", "blob", "bucket", "object-store", "file-store"),
    "monitoring": ("monitoring", "prometheus", "datadog", "grafana", "new-relic", "newrelic", "nagios", "pagerduty", "alertmanager", "observability"),
    "search": ("search", "elasticsearch", "solr", "algolia", "meilisearch", "opensearch"),
    "container-registry": ("registry", "ecr", "gcr", "docker-hub", "harbor", "container-registry"),
    "config-server": ("config", "consul", "etcd", "vault", "config-server", "spring-cloud-config", "zookeeper"),
    "log-aggregator": ("log", "logging", "elasticsearch", "elk", "splunk", "loki", "fluentd", "logstash", "kibana", "log-aggregator"),
    "orchestrator": ("orchestrator", "kubernetes", "k8s", "nomad", "mesos", "docker-swarm", "swarm", "openshift", "rancher"),
    "secrets-manager": ("secrets-manager", "secrets", "vault", "aws-secrets-manager", "secretsmanager", "azure-key-vault", "key-vault"),
}


# The component types in their canonical order, which breaks ties.
ORDER = (
    "service", "database", "cache", "queue", "message-broker", "load-balancer", "gateway", "storage", "container-registry", "config-server", "monitoring", "log-aggregator", "orchestrator", "secrets-manager", "search",
)
# Confidence of a type that the first, the second, or a later context names.
CONTEXT_CONFIDENCE = (0.75, 0.70, 0.65)


def inferred_type(name: Column, *context: Column) -> Column:
    """``struct<type, confidence>``: exact type .95; keywords .85 and .05 for each further one, .95 at most; then the context; else unknown .5.

    The longest keyword decides; among equally long ones the first type in ORDER.  Of
    the contexts (the title first) the first that holds a keyword decides, again by the
    first type in ORDER.  A null name is unknown.
    """
    low = F.coalesce(F.lower(name), F.lit(""))
    pairs = [(k, t) for t in ORDER for k in KEYWORDS[t]]
    rows = F.array(*[F.struct(F.lit(len(k)).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("k"), F.lit(t).alias("type")) for i, (k, t) in enumerate(pairs)])
    # a function over an array of one stands for a variable: the keywords are looked up once
    held = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    counted = lambda hits: held(F.array_max(hits)["type"], lambda best: F.struct(best.alias("type"), F.size(F.filter(hits, lambda r: r["type"] == best)).alias("n")))
    exact = low.isin(*KEYWORDS)

    def chosen(best: Column) -> Column:
        score = F.round(F.least(F.lit(0.95), 0.85 + 0.05 * (best["n"] - 1)), 4)
        return result(F.when(exact, low).when(best["n"] > 0, best["type"]), F.when(exact, 0.95).when(best["n"] > 0, score))

    def result(kind: Column, value: Column) -> Column:
        for i, text in enumerate(context):
            around = F.coalesce(F.lower(text), F.lit(""))
            first = F.get(F.filter(rows, lambda r: F.contains(around, r["k"])), F.lit(0))["type"]  # noqa: B023  used at once
            kind, value = kind.when(first.isNotNull(), first), value.when(first.isNotNull(), CONTEXT_CONFIDENCE[min(i, 2)])
        return F.struct(kind.otherwise("unknown").alias("type"), value.otherwise(0.5).alias("confidence"))

    return held(F.filter(rows, lambda r: F.contains(low, r["k"])), lambda hits: held(counted(hits), chosen))


def seeded_type(name: Column, mappings: list[tuple[str, str]]) -> Column:
    """``struct<type, confidence>`` by the first (pattern, type) that fits, null if none: ``x*`` is a prefix, others a substring, in either case."""
    low = F.lower(name)
    fits = lambda p: F.startswith(low, F.lit(p[:-1])) if p.endswith("*") else F.contains(low, F.lit(p))
    found = [F.when(fits(p.lower()), F.struct(F.lit(t).alias("type"), F.lit(1.0).alias("confidence"))) for p, t in mappings]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<type: string, confidence: double>")


def detected(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """``id, confidence``: by name .9, by title .7, by at least three incoming edges .4."""
    named = F.lower("id").rlike("component|service")
    titled = F.lower("title").rlike("component|service")
    score = F.when(named, 0.9).when(titled, 0.7).when(F.col("incoming_edges") >= 3, 0.4)
    return nodes.join(degrees, "id", "left").select("id", score.alias("confidence")).where(F.col("confidence").isNotNull())


def longest_prefix(files: DataFrame, components: DataFrame) -> DataFrame:
    """``file, component``: the component whose path is the longest ancestor of the file's folder.

    Ancestors are exploded, so this is an equi-join.
    """
    parts = F.split(F.regexp_extract("file", "^(.*)/", 1), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hits = files.select("file", F.explode(ancestors).alias("path")).join(components.select("path", "component"), "path")
    order = Window.partitionBy("file").orderBy(F.length("path").desc(), "component")
    return hits.withColumn("at", F.row_number().over(order)).where("at = 1").select("file", "component")


def normalised_groups(names: DataFrame, normal: Column) -> DataFrame:
    """Names that become equal when normalised: ``normal, variants, n`` where n > 1."""
    return names.withColumn("normal", normal).groupBy("normal").agg(F.sort_array(F.collect_set("name")).alias("variants"), F.countDistinct("name").alias("n")).where("n > 1")
