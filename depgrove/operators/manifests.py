"""Dependencies that manifest files declare."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# AWS services by their package, with the component and its type; both generations of the library have the first ones, the second has all.
_AWS = {
    "s3": ("aws-s3", "storage"), "sqs": ("aws-sqs", "queue"), "sns": ("aws-sns", "queue"), "dynamodb": ("aws-dynamodb", "database"), "secretsmanager": ("aws-secrets-manager", "service"),
    "ecr": ("aws-ecr", "container-registry"), "sts": ("aws-sts", "service"), "kinesis": ("aws-kinesis", "queue"), "rds": ("aws-rds", "database"),
}
_AWS_LATER = {"iam": ("aws-iam", "service"), "lambda": ("aws-lambda", "service"), "cloudwatch": ("aws-cloudwatch", "monitoring"), "elasticache": ("aws-elasticache", "cache")}
# Module path of Go, component, type, confidence.
MODULES = {
    **{f"github.com/aws/aws-sdk-go-v2/service/{k}": (*v, 0.9) for k, v in (_AWS | _AWS_LATER).items()}, **{f"github.com/aws/aws-sdk-go/service/{k}": (*v, 0.9) for k, v in _AWS.items()},
    "github.com/aws/aws-sdk-go-v2": ("aws", "cloud-platform", 0.7), "github.com/aws/aws-sdk-go": ("aws", "cloud-platform", 0.7),
    "github.com/aws-controllers-k8s/ecr-controller": ("aws-ecr", "container-registry", 0.85), "github.com/aws-controllers-k8s/s3-controller": ("aws-s3", "storage", 0.85),
    "github.com/aws-controllers-k8s/rds-controller": ("aws-rds", "database", 0.85), "database/sql": ("sql-database", "database", 0.8), "github.com/jmoiron/sqlx": ("sql-database", "database", 0.8),
    "gorm.io/gorm": ("sql-database", "database", 0.8), "github.com/jinzhu/gorm": ("sql-database", "database", 0.8), "go.mongodb.org/mongo-driver": ("mongodb", "database", 0.9),
    "github.com/lib/pq": ("postgres", "database", 0.85), "github.com/jackc/pgx": ("postgres", "database", 0.85), "github.com/go-sql-driver/mysql": ("mysql", "database", 0.85),
    "github.com/redis/go-redis": ("redis", "cache", 0.9), "github.com/go-redis/redis": ("redis", "cache", 0.9), "github.com/bradfitz/gomemcache": ("memcached", "cache", 0.9),
    "github.com/patrickmn/go-cache": ("in-memory-cache", "cache", 0.7), "github.com/IBM/sarama": ("kafka", "message-broker", 0.9), "github.com/Shopify/sarama": ("kafka", "message-broker", 0.9),
    "github.com/segmentio/kafka-go": ("kafka", "message-broker", 0.9), "github.com/confluentinc/confluent-kafka-go": ("kafka", "message-broker", 0.9),
    "github.com/rabbitmq/amqp091-go": ("rabbitmq", "message-broker", 0.9), "github.com/streadway/amqp": ("rabbitmq", "message-broker", 0.9), "github.com/nats-io/nats.go": ("nats", "message-broker", 0.9),
    "gopkg.in/DataDog/dd-trace-go.v1": ("datadog", "monitoring", 0.9), "github.com/DataDog/datadog-go": ("datadog", "monitoring", 0.9), "github.com/prometheus/client_golang": ("prometheus", "monitoring", 0.9),
    "go.opentelemetry.io/otel": ("opentelemetry", "monitoring", 0.85), "github.com/newrelic/go-agent": ("new-relic", "monitoring", 0.9), "github.com/getsentry/sentry-go": ("sentry", "monitoring", 0.9),
    "github.com/elastic/go-elasticsearch": ("elasticsearch", "search", 0.9), "github.com/olivere/elastic": ("elasticsearch", "search", 0.9), "k8s.io/client-go": ("kubernetes", "orchestrator", 0.85),
    "sigs.k8s.io/controller-runtime": ("kubernetes", "orchestrator", 0.85), "github.com/pivotal/kpack": ("kpack", "build-service", 0.9),
    "github.com/kubernetes-sigs/service-catalog": ("service-catalog", "service-broker", 0.9), "google.golang.org/grpc": ("grpc", "service", 0.8),
    "github.com/hashicorp/vault/api": ("vault", "secrets-manager", 0.9), "github.com/google/go-containerregistry": ("container-registry", "container-registry", 0.85),
}
# Platforms that give way to their own services.
PLATFORMS = ("aws", "kubernetes")


def gomod_signals(files: DataFrame) -> DataFrame:
    """Known modules that ``go.mod`` files require themselves, as code signals; each component once a file.

    ``files`` has ``src, path, content``.  A module stands for the mapping of its longest
    ancestor; indirect ones, replacements and exclusions do not count.  A platform is
    left out where a file requires one of its services.
    """
    lines = files.where(F.regexp(F.col("path"), F.lit(r"(?:^|/)go\.mod$"))).select("src", "path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
    opened = F.when(F.regexp(F.col("line"), F.lit(r"^\s*\w+\s*\(")), F.regexp_extract("line", r"^\s*(\w+)\s*\(", 1)).when(F.regexp(F.col("line"), F.lit(r"^\s*\)")), "")
    block = F.coalesce(F.last(opened, ignorenulls=True).over(Window.partitionBy("src", "path").orderBy("pos")), F.lit(""))
    given = F.when(block == "require", F.col("line")).when(block == "", F.regexp_extract("line", r"^\s*require\s+([^(].*)$", 1))
    need = lines.withColumn("given", given).where(~F.regexp(F.col("line"), F.lit(r"//\s*indirect\b")))
    pair = r'^\s*"?([^\s"()]+)"?\s+(v[^\s/]\S*)'
    need = need.select("src", "path", (F.col("pos") + 1).cast("int").alias("line_number"), F.regexp_extract("given", pair, 1).alias("module"), F.regexp_extract("given", pair, 2).alias("release")).where("module != ''")
    parts = F.split("module", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    known = files.sparkSession.createDataFrame([(k, *v) for k, v in MODULES.items()], "prefix string, component string, target_type string, confidence double")
    hits = need.select("*", F.explode(ancestors).alias("prefix")).join(F.broadcast(known), "prefix")  # a mapping of fixed size
    best = hits.groupBy("src", "path", "line_number", "module", "release").agg(F.max_by(F.struct("component", "target_type", "confidence"), F.length("prefix")).alias("x"))
    once = best.groupBy("src", "path", "x.component").agg(F.min(F.struct("line_number", "module", "release", "x.target_type", "x.confidence")).alias("y"))
    together = Window.partitionBy("src", "path")
    own = [F.max(F.startswith("component", F.lit(f"{p}-"))).over(together).alias(p) for p in PLATFORMS]
    kept = once.select("*", *own).where(~F.coalesce(*[F.when(F.col("component") == p, F.col(p)) for p in PLATFORMS], F.lit(False)))
    return kept.select(
        F.col("src").alias("source_component"), F.col("component").alias("target_component"), F.col("y.target_type").alias("target_type"), F.lit("sdk_import").alias("signal_type"), F.col("y.confidence").alias("confidence"),
        F.concat_ws(" ", "y.module", "y.release").alias("evidence"), F.col("path").alias("file_path"), F.col("y.line_number").alias("line_number"), F.lit("go").alias("language"),
    )
