"""Signals from source code: calls of known client libraries, comments, environment variables, Terraform.

``lexing`` lists the imports and calls of a file; the import of its object or name gives
a call its library, and (language, library, function) joins the catalog.  A file's text
goes no further than the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depgrove.functions.text import connection_target, connection_type
from depgrove.operators.lexing import scanned
from depgrove.operators.manifests import gomod_signals
from depgrove.session import checkpointed

# Extension, language.
LANGUAGES = {"go": "go", "py": "python", "js": "javascript", "ts": "javascript", "jsx": "javascript", "tsx": "javascript", "tf": "terraform"}
# Language, import, function, form of the call, kind, type of the target.
CALLS = [
    ("go", "net/http", "Get", "of", "http_call", "service"),
    ("go", "net/http", "Post", "of", "http_call", "service"),
    ("go", "net/http", "NewRequest", "of", "http_call", "service"),
    ("go", "database/sql", "Open", "of", "db_connection", "database"),
    ("go", "github.com/jmoiron/sqlx", "Connect", "of", "db_connection", "database"),
    ("go", "github.com/jmoiron/sqlx", "Open", "of", "db_connection", "database"),
    ("go", "gorm.io/gorm", "Open", "of", "db_connection", "database"),
    ("go", "go.mongodb.org/mongo-driver/mongo", "Connect", "of", "db_connection", "database"),
    ("go", "github.com/redis/go-redis/v9", "NewClient", "of", "cache_client", "cache"),
    ("go", "github.com/go-redis/redis/v8", "NewClient", "of", "cache_client", "cache"),
    ("go", "github.com/bradfitz/gomemcache/memcache", "New", "of", "cache_client", "cache"),
    ("go", "github.com/IBM/sarama", "NewSyncProducer", "of", "queue_producer", "message-broker"),
    ("go", "github.com/IBM/sarama", "NewAsyncProducer", "of", "queue_producer", "message-broker"),
    ("go", "github.com/IBM/sarama", "NewConsumer", "of", "queue_consumer", "message-broker"),
    ("go", "github.com/IBM/sarama", "NewConsumerGroup", "of", "queue_consumer", "message-broker"),
    ("go", "github.com/rabbitmq/amqp091-go", "Dial", "of", "queue_producer", "message-broker"),
    ("go", "github.com/nats-io/nats.go", "Connect", "of", "queue_producer", "message-broker"),
    ("go", "github.com/aws/aws-sdk-go-v2/service/sqs", "NewFromConfig", "of", "queue_producer", "queue"),
    ("go", "github.com/aws/aws-sdk-go-v2/service/s3", "NewFromConfig", "of", "storage_client", "storage"),
    ("go", "github.com/aws/aws-sdk-go-v2/service/s3", "New", "of", "storage_client", "storage"),
    ("go", "github.com/aws/aws-sdk-go-v2/service/dynamodb", "NewFromConfig", "of", "db_connection", "database"),
    ("go", "github.com/aws/aws-sdk-go-v2/service/ecr", "NewFromConfig", "of", "registry_client", "container-registry"),
    ("go", "github.com/aws/aws-sdk-go-v2/service/secretsmanager", "NewFromConfig", "of", "secrets_client", "secrets-manager"),
    ("go", "github.com/aws/aws-sdk-go-v2/service/sns", "NewFromConfig", "of", "queue_producer", "queue"),
    ("go", "github.com/aws/aws-sdk-go-v2/service/kinesis", "NewFromConfig", "of", "queue_producer", "queue"),
    ("go", "github.com/aws/aws-sdk-go-v2/service/sts", "NewFromConfig", "of", "auth_client", "service"),
    ("go", "github.com/aws/aws-sdk-go/service/s3", "New", "of", "storage_client", "storage"),
    ("go", "github.com/aws/aws-sdk-go/service/sqs", "New", "of", "queue_producer", "queue"),
    ("go", "github.com/aws/aws-sdk-go/service/dynamodb", "New", "of", "db_connection", "database"),
    ("go", "github.com/aws/aws-sdk-go/service/ecr", "New", "of", "registry_client", "container-registry"),
    ("go", "github.com/aws/aws-sdk-go/service/secretsmanager", "New", "of", "secrets_client", "secrets-manager"),
    ("go", "github.com/aws/aws-sdk-go/service/sns", "New", "of", "queue_producer", "queue"),
    ("go", "gopkg.in/DataDog/dd-trace-go.v1/ddtrace/tracer", "Start", "of", "monitoring_client", "monitoring"),
    ("go", "github.com/DataDog/datadog-go/v5/statsd", "New", "of", "monitoring_client", "monitoring"),
    ("go", "github.com/prometheus/client_golang/prometheus", "NewCounter", "of", "monitoring_client", "monitoring"),
    ("go", "github.com/prometheus/client_golang/prometheus", "NewGauge", "of", "monitoring_client", "monitoring"),
    ("go", "github.com/prometheus/client_golang/prometheus", "NewHistogram", "of", "monitoring_client", "monitoring"),
    ("go", "google.golang.org/grpc", "Dial", "of", "http_call", "service"),
    ("go", "google.golang.org/grpc", "DialContext", "of", "http_call", "service"),
    ("go", "google.golang.org/grpc", "NewClient", "of", "http_call", "service"),
    ("go", "github.com/hashicorp/vault/api", "NewClient", "of", "secrets_client", "secrets-manager"),
    ("go", "github.com/elastic/go-elasticsearch/v8", "NewClient", "of", "search_client", "search"),
    ("go", "github.com/olivere/elastic", "NewClient", "of", "search_client", "search"),
    ("go", "github.com/google/go-containerregistry/pkg/crane", "Pull", "of", "registry_client", "container-registry"),
    ("go", "github.com/google/go-containerregistry/pkg/crane", "Push", "of", "registry_client", "container-registry"),
    ("go", "github.com/getsentry/sentry-go", "Init", "of", "monitoring_client", "monitoring"),
    ("go", "go.opentelemetry.io/otel/exporters/otlp/otlptrace/otlptracegrpc", "New", "of", "monitoring_client", "monitoring"),
    ("go", "github.com/gin-gonic/gin", "New", "of", "http_server", "service"),
    ("go", "github.com/gin-gonic/gin", "Default", "of", "http_server", "service"),
    ("go", "github.com/labstack/echo/v4", "New", "of", "http_server", "service"),
    ("go", "github.com/gofiber/fiber/v2", "New", "of", "http_server", "service"),
    ("go", "github.com/go-chi/chi/v5", "NewRouter", "of", "http_server", "service"),
    ("go", "github.com/gorilla/mux", "NewRouter", "of", "http_server", "service"),
    ("go", "net/http", "ListenAndServe", "of", "http_server", "service"),
    ("go", "net/http", "ListenAndServeTLS", "of", "http_server", "service"),
    ("go", "net/http", "Serve", "of", "http_server", "service"),
    ("go", "github.com/graphql-go/graphql", "NewSchema", "of", "http_server", "service"),
    ("go", "github.com/99designs/gqlgen/graphql/handler", "NewDefaultServer", "of", "http_server", "service"),
    ("go", "sigs.k8s.io/controller-runtime/pkg/client", "New", "of", "k8s_client", "orchestrator"),
    ("go", "sigs.k8s.io/controller-runtime/pkg/manager", "New", "of", "k8s_client", "orchestrator"),
    ("go", "k8s.io/client-go/kubernetes", "NewForConfig", "of", "k8s_client", "orchestrator"),
    ("go", "k8s.io/client-go/rest", "InClusterConfig", "of", "k8s_client", "orchestrator"),
    ("go", "k8s.io/client-go/dynamic", "NewForConfig", "of", "k8s_client", "orchestrator"),
    ("go", "github.com/jackc/pgx/v5/pgxpool", "Connect", "of", "db_connection", "database"),
    ("go", "github.com/jackc/pgx/v5/pgxpool", "New", "of", "db_connection", "database"),
    ("go", "github.com/jackc/pgx/v5", "Connect", "of", "db_connection", "database"),
    ("go", "gorm.io/driver/postgres", "Open", "of", "db_connection", "database"),
    ("go", "gorm.io/driver/mysql", "Open", "of", "db_connection", "database"),
    ("go", "gorm.io/driver/sqlite", "Open", "of", "db_connection", "database"),
    ("go", "github.com/gocql/gocql", "NewCluster", "of", "db_connection", "database"),
    ("go", "github.com/influxdata/influxdb-client-go/v2", "New", "of", "db_connection", "database"),
    ("go", "github.com/go-resty/resty/v2", "New", "of", "http_call", "service"),
    ("go", "net/http", "Head", "of", "http_call", "service"),
    ("go", "net/http", "Put", "of", "http_call", "service"),
    ("go", "net/http", "Patch", "of", "http_call", "service"),
    ("go", "net/http", "Delete", "of", "http_call", "service"),
    ("go", "github.com/apache/pulsar-client-go/pulsar", "NewClient", "of", "queue_producer", "message-broker"),
    ("go", "github.com/nsqio/go-nsq", "NewProducer", "of", "queue_producer", "message-broker"),
    ("go", "github.com/nsqio/go-nsq", "NewConsumer", "of", "queue_consumer", "message-broker"),
    ("go", "github.com/aws/aws-sdk-go/service/kinesis", "New", "of", "queue_producer", "queue"),
    ("go", "github.com/aws/aws-sdk-go-v2/service/eventbridge", "NewFromConfig", "of", "queue_producer", "queue"),
    ("go", "github.com/aws/aws-sdk-go/service/eventbridge", "New", "of", "queue_producer", "queue"),
    ("go", "github.com/hashicorp/consul/api", "NewClient", "of", "config_client", "config-server"),
    ("go", "go.etcd.io/etcd/client/v3", "New", "of", "config_client", "config-server"),
    ("go", "github.com/spf13/viper", "New", "of", "config_client", "config-server"),
    ("go", "github.com/jaegertracing/jaeger-client-go", "NewTracer", "of", "monitoring_client", "monitoring"),
    ("go", "github.com/openzipkin/zipkin-go", "NewTracer", "of", "monitoring_client", "monitoring"),
    ("go", "github.com/cactus/go-statsd-client/v5/statsd", "NewClient", "of", "monitoring_client", "monitoring"),
    ("go", "github.com/prometheus/client_golang/prometheus", "NewSummary", "of", "monitoring_client", "monitoring"),
    ("go", "github.com/newrelic/go-agent/v3/newrelic", "NewApplication", "of", "monitoring_client", "monitoring"),
    ("python", "requests", "get", "of", "http_call", "service"),
    ("python", "requests", "post", "of", "http_call", "service"),
    ("python", "requests", "put", "of", "http_call", "service"),
    ("python", "requests", "delete", "of", "http_call", "service"),
    ("python", "requests", "patch", "of", "http_call", "service"),
    ("python", "httpx", "get", "of", "http_call", "service"),
    ("python", "httpx", "post", "of", "http_call", "service"),
    ("python", "httpx", "put", "of", "http_call", "service"),
    ("python", "httpx", "delete", "of", "http_call", "service"),
    ("python", "psycopg2", "connect", "of", "db_connection", "database"),
    ("python", "asyncpg", "connect", "of", "db_connection", "database"),
    ("python", "asyncpg", "create_pool", "of", "db_connection", "database"),
    ("python", "pymongo", "MongoClient", "of", "db_connection", "database"),
    ("python", "sqlalchemy", "create_engine", "of", "db_connection", "database"),
    ("python", "pymysql", "connect", "of", "db_connection", "database"),
    ("python", "redis", "Redis", "of", "cache_client", "cache"),
    ("python", "redis", "StrictRedis", "of", "cache_client", "cache"),
    ("python", "redis", "from_url", "of", "cache_client", "cache"),
    ("python", "pymemcache.client", "Client", "of", "cache_client", "cache"),
    ("python", "kafka", "KafkaProducer", "of", "queue_producer", "message-broker"),
    ("python", "kafka", "KafkaConsumer", "of", "queue_consumer", "message-broker"),
    ("python", "pika", "BlockingConnection", "of", "queue_producer", "message-broker"),
    ("python", "boto3", "client", "of", "queue_producer", "queue"),
    ("python", "flask", "Flask", "of", "http_server", "service"),
    ("python", "fastapi", "FastAPI", "of", "http_server", "service"),
    ("python", "django.http", "HttpResponse", "of", "http_server", "service"),
    ("python", "psycopg2.pool", "SimpleConnectionPool", "of", "db_connection", "database"),
    ("python", "psycopg2.pool", "ThreadedConnectionPool", "of", "db_connection", "database"),
    ("python", "redis", "ConnectionPool", "of", "cache_client", "cache"),
    ("python", "sqlalchemy", "sessionmaker", "of", "db_connection", "database"),
    ("python", "sqlalchemy.orm", "Session", "of", "db_connection", "database"),
    ("python", "boto3", "resource", "of", "db_connection", "database"),
    ("python", "elasticsearch", "Elasticsearch", "of", "search_client", "search"),
    ("python", "celery", "Celery", "of", "queue_producer", "message-broker"),
    ("javascript", "axios", "get", "of", "http_call", "service"),
    ("javascript", "axios", "post", "of", "http_call", "service"),
    ("javascript", "axios", "put", "of", "http_call", "service"),
    ("javascript", "axios", "delete", "of", "http_call", "service"),
    ("javascript", "axios", "patch", "of", "http_call", "service"),
    ("javascript", "axios", "request", "of", "http_call", "service"),
    ("javascript", "", "fetch", "bare", "http_call", "service"),
    ("javascript", "got", "get", "of", "http_call", "service"),
    ("javascript", "got", "post", "of", "http_call", "service"),
    ("javascript", "pg", "Pool", "new", "db_connection", "database"),
    ("javascript", "pg", "Client", "new", "db_connection", "database"),
    ("javascript", "mysql2", "createConnection", "of", "db_connection", "database"),
    ("javascript", "mysql2", "createPool", "of", "db_connection", "database"),
    ("javascript", "mongoose", "connect", "of", "db_connection", "database"),
    ("javascript", "mongodb", "MongoClient", "new", "db_connection", "database"),
    ("javascript", "@prisma/client", "PrismaClient", "new", "db_connection", "database"),
    ("javascript", "sequelize", "Sequelize", "new", "db_connection", "database"),
    ("javascript", "ioredis", "Redis", "new", "cache_client", "cache"),
    ("javascript", "redis", "createClient", "of", "cache_client", "cache"),
    ("javascript", "kafkajs", "Kafka", "new", "queue_producer", "message-broker"),
    ("javascript", "amqplib", "connect", "of", "queue_producer", "message-broker"),
    ("javascript", "@aws-sdk/client-sqs", "SQSClient", "new", "queue_producer", "queue"),
    ("javascript", "express", "Router", "of", "http_server", "service"),
    ("javascript", "fastify", "fastify", "of", "http_server", "service"),
    ("javascript", "koa", "Koa", "new", "http_server", "service"),
    ("javascript", "typeorm", "createConnection", "of", "db_connection", "database"),
    ("javascript", "typeorm", "DataSource", "new", "db_connection", "database"),
    ("javascript", "knex", "knex", "of", "db_connection", "database"),
    ("javascript", "node-cache", "NodeCache", "new", "cache_client", "cache"),
    ("javascript", "@elastic/elasticsearch", "Client", "new", "search_client", "search"),
    ("javascript", "@aws-sdk/client-s3", "S3Client", "new", "storage_client", "storage"),
    ("javascript", "@aws-sdk/client-dynamodb", "DynamoDBClient", "new", "db_connection", "database"),
    ("javascript", "apollo-server", "ApolloServer", "new", "http_server", "service"),
    ("javascript", "@apollo/server", "ApolloServer", "new", "http_server", "service"),
    # not in the reference
    ("python", "httpx", "patch", "of", "http_call", "service"),
    ("python", "httpx", "Client", "of", "http_call", "service"),
    ("python", "httpx", "AsyncClient", "of", "http_call", "service"),
    ("go", "github.com/redis/go-redis/v9", "NewClusterClient", "of", "cache_client", "cache"),
    ("javascript", "axios", "axios", "bare", "http_call", "service"),
]
# Resource prefix of Terraform, type and confidence of the target; the first that fits decides.
RESOURCES = {
    "aws_db_instance": ("database", 0.92),
    "aws_db_cluster": ("database", 0.92),
    "aws_rds_cluster": ("database", 0.92),
    "aws_rds_": ("database", 0.85),
    "aws_dynamodb_table": ("database", 0.92),
    "aws_dynamodb_": ("database", 0.85),
    "aws_docdb_": ("database", 0.88),
    "aws_redshift_": ("database", 0.88),
    "aws_neptune_": ("database", 0.88),
    "aws_timestream_": ("database", 0.85),
    "aws_elasticache_cluster": ("cache", 0.92),
    "aws_elasticache_replication_group": ("cache", 0.92),
    "aws_elasticache_": ("cache", 0.85),
    "aws_sqs_queue": ("queue", 0.92),
    "aws_sqs_": ("queue", 0.85),
    "aws_sns_topic": ("message-broker", 0.88),
    "aws_sns_": ("message-broker", 0.82),
    "aws_msk_cluster": ("message-broker", 0.92),
    "aws_msk_": ("message-broker", 0.85),
    "aws_kinesis_stream": ("message-broker", 0.88),
    "aws_kinesis_": ("message-broker", 0.82),
    "aws_eventbridge_": ("message-broker", 0.82),
    "aws_s3_bucket": ("storage", 0.92),
    "aws_s3_": ("storage", 0.85),
    "aws_efs_": ("storage", 0.85),
    "aws_lb_": ("load-balancer", 0.90),
    "aws_lb": ("load-balancer", 0.90),
    "aws_alb_": ("load-balancer", 0.90),
    "aws_alb": ("load-balancer", 0.90),
    "aws_elb": ("load-balancer", 0.88),
    "aws_api_gateway": ("gateway", 0.92),
    "aws_apigatewayv2_": ("gateway", 0.92),
    "aws_eks_cluster": ("orchestrator", 0.92),
    "aws_eks_": ("orchestrator", 0.85),
    "aws_ecs_cluster": ("orchestrator", 0.88),
    "aws_ecs_": ("orchestrator", 0.82),
    "aws_lambda_function": ("service", 0.92),
    "aws_lambda_": ("service", 0.85),
    "aws_instance": ("service", 0.80),
    "aws_autoscaling_group": ("service", 0.80),
    "aws_apprunner_": ("service", 0.85),
    "aws_ecr_repository": ("container-registry", 0.92),
    "aws_ecr_": ("container-registry", 0.85),
    "aws_secretsmanager_secret": ("secrets-manager", 0.92),
    "aws_secretsmanager_": ("secrets-manager", 0.85),
    "aws_ssm_parameter": ("config-server", 0.88),
    "aws_ssm_": ("config-server", 0.80),
    "aws_appconfig_": ("config-server", 0.82),
    "aws_cloudwatch_log_": ("log-aggregator", 0.90),
    "aws_cloudwatch_": ("monitoring", 0.85),
    "aws_elasticsearch_domain": ("search", 0.92),
    "aws_opensearch_domain": ("search", 0.92),
    "aws_opensearch_": ("search", 0.85),
    "kubernetes_deployment": ("service", 0.85),
    "kubernetes_stateful_set": ("service", 0.85),
    "kubernetes_daemonset": ("service", 0.82),
    "kubernetes_cron_job": ("service", 0.80),
    "kubernetes_ingress": ("gateway", 0.85),
    "kubernetes_service": ("service", 0.80),
    "helm_release": ("service", 0.78),
    "google_sql_database": ("database", 0.85),
    "google_redis_instance": ("cache", 0.85),
    "google_storage_bucket": ("storage", 0.85),
}
# Part of a Terraform module's source, type of the target; the first that fits decides.
MODULES = {
    "terraform-aws-modules/rds": "database", "terraform-aws-modules/aurora": "database", "terraform-aws-modules/dynamodb-table": "database", "terraform-aws-modules/elasticache": "cache",
    "terraform-aws-modules/sqs": "queue", "terraform-aws-modules/msk": "message-broker", "terraform-aws-modules/kafka": "message-broker", "terraform-aws-modules/s3-bucket": "storage",
    "terraform-aws-modules/efs": "storage", "terraform-aws-modules/eks": "orchestrator", "terraform-aws-modules/ecs": "orchestrator", "terraform-aws-modules/lambda": "service",
    "terraform-aws-modules/alb": "load-balancer", "terraform-aws-modules/elb": "load-balancer", "terraform-aws-modules/api-gateway": "gateway", "terraform-aws-modules/ecr": "container-registry",
    "terraform-aws-modules/secrets-manager": "secrets-manager",
}
# Confidence of a kind of call, 0.85 for the others.
KIND_CONFIDENCE = {"http_call": 0.9, "http_server": 0.9, "k8s_client": 0.9, "config_client": 0.9, "monitoring_client": 0.9}
# Libraries and calls whose confidence is another one.
CALL_CONFIDENCE = {
    "github.com/go-resty/resty/v2": 0.85, "github.com/graphql-go/graphql": 0.85, "django.http": 0.85, "go.opentelemetry.io/otel/exporters/otlp/otlptrace/otlptracegrpc": 0.85,
    "github.com/cactus/go-statsd-client/v5/statsd": 0.85, "github.com/spf13/viper": 0.7, "github.com/prometheus/client_golang/prometheus": 0.8, "github.com/hashicorp/vault/api": 0.9,
    "github.com/apache/pulsar-client-go/pulsar": 0.9, "github.com/nsqio/go-nsq": 0.9, "gorm.io/driver/postgres": 0.9, "gorm.io/driver/mysql": 0.9, "gorm.io/driver/sqlite": 0.9,
    "github.com/gocql/gocql": 0.9, "github.com/jackc/pgx/v5/pgxpool": 0.9, "github.com/jackc/pgx/v5": 0.9, "net/http.ListenAndServe": 0.95, "net/http.ListenAndServeTLS": 0.95,
}
# Place of the argument that names the target, by library or call; calls over http have it first, the others nowhere.
ARGUMENT = {
    "net/http.NewRequest": 1, "google.golang.org/grpc.DialContext": 1, "github.com/go-resty/resty/v2": -1, "net/http.ListenAndServe": 0, "net/http.ListenAndServeTLS": 0,
    "database/sql": 1, "github.com/jmoiron/sqlx": 1, "go.mongodb.org/mongo-driver/mongo": 1, "github.com/jackc/pgx/v5/pgxpool": 1, "github.com/jackc/pgx/v5": 1,
    "gorm.io/gorm": 0, "gorm.io/driver/postgres": 0, "gorm.io/driver/mysql": 0, "gorm.io/driver/sqlite": 0, "github.com/gocql/gocql": 0, "github.com/influxdata/influxdb-client-go/v2": 0,
    "github.com/bradfitz/gomemcache/memcache": 0, "github.com/rabbitmq/amqp091-go": 0, "github.com/nats-io/nats.go": 0, "github.com/nsqio/go-nsq.NewProducer": 0,
    "github.com/DataDog/datadog-go/v5/statsd": 0, "github.com/cactus/go-statsd-client/v5/statsd": 0, "github.com/google/go-containerregistry/pkg/crane.Pull": 0,
    "psycopg2": 0, "asyncpg": 0, "pymongo": 0, "sqlalchemy.create_engine": 0, "pymysql": 0, "redis.from_url": 0, "pymemcache.client": 0,
    "mysql2": 0, "mongoose": 0, "mongodb": 0, "sequelize": 0, "ioredis": 0, "amqplib": 0,
}
# Target of a call that names none, by library; else the last part of the library's path.
FALLBACK = {
    "gopkg.in/DataDog/dd-trace-go.v1/ddtrace/tracer": "datadog", "github.com/DataDog/datadog-go/v5/statsd": "datadog", "github.com/prometheus/client_golang/prometheus": "prometheus",
    "github.com/hashicorp/vault/api": "vault", "github.com/elastic/go-elasticsearch/v8": "elasticsearch", "github.com/olivere/elastic": "elasticsearch", "github.com/getsentry/sentry-go": "sentry",
    "go.opentelemetry.io/otel/exporters/otlp/otlptrace/otlptracegrpc": "opentelemetry", "sigs.k8s.io/controller-runtime/pkg/client": "kubernetes", "sigs.k8s.io/controller-runtime/pkg/manager": "kubernetes",
    "k8s.io/client-go/kubernetes": "kubernetes", "k8s.io/client-go/rest": "kubernetes", "k8s.io/client-go/dynamic": "kubernetes", "github.com/jackc/pgx/v5/pgxpool": "postgresql",
    "github.com/jackc/pgx/v5": "postgresql", "gorm.io/driver/postgres": "postgresql", "gorm.io/driver/mysql": "mysql", "gorm.io/driver/sqlite": "sqlite", "github.com/gocql/gocql": "cassandra",
    "github.com/influxdata/influxdb-client-go/v2": "influxdb", "github.com/apache/pulsar-client-go/pulsar": "pulsar", "github.com/nsqio/go-nsq": "nsq", "github.com/aws/aws-sdk-go/service/kinesis": "kinesis",
    "github.com/aws/aws-sdk-go-v2/service/eventbridge": "eventbridge", "github.com/aws/aws-sdk-go/service/eventbridge": "eventbridge", "github.com/hashicorp/consul/api": "consul",
    "go.etcd.io/etcd/client/v3": "etcd", "github.com/jaegertracing/jaeger-client-go": "jaeger", "github.com/openzipkin/zipkin-go": "zipkin", "github.com/cactus/go-statsd-client/v5/statsd": "statsd",
    "github.com/newrelic/go-agent/v3/newrelic": "newrelic",
}
# Prefixes and suffixes of variables that hold a connection, and what some prefixes lead to (the second table in Go files only).
CONNECTION_SUFFIXES = ("_URL", "_DSN", "_URI", "_HOST", "_ADDR", "_ENDPOINT", "_CONNECTION")
CONNECTION_PREFIXES = (
    "DATABASE_", "DB_", "REDIS_", "MONGO_", "RABBIT_", "KAFKA_", "NATS_", "AMQP_", "S3_", "AWS_", "DD_", "DATADOG_", "SENTRY_", "ELASTICSEARCH_", "ELASTIC_",
    "VAULT_", "OAUTH_", "MXID_", "SLACK_", "ALERT_", "ECR_", "GRPC_", "CLOUDPORTAL_", "PROMETHEUS_",
)
VARIABLE_TYPES = {"DATABASE": "database", "DB": "database", "MONGO": "database", "REDIS": "cache", "KAFKA": "message-broker", "RABBIT": "message-broker", "AMQP": "message-broker", "NATS": "message-broker"}
GO_VARIABLE_TYPES = {
    "S3": "storage", "ECR": "container-registry", "DD": "monitoring", "DATADOG": "monitoring", "SENTRY": "monitoring", "PROMETHEUS": "monitoring", "ELASTICSEARCH": "search", "ELASTIC": "search",
    "VAULT": "secrets-manager", "OAUTH": "auth-service", "MXID": "auth-service", "SLACK": "notification", "ALERT": "alerting", "CLOUDPORTAL": "service", "GRPC": "service",
}
# Patterns of dependencies that comments state, types of addresses in them, and hosts that are none.
STATED = r"(?i)(?:calls|depends on|uses|connects to|talks to|sends to|reads from|writes to)\s++(\w[\w-]*+(?:\.\w[\w-]*+)*+)"
PLANNED = r"(?:TODO|FIXME|HACK|XXX)"
# without a target a match ends with its line, before a mark that ends the line, and gives "": so no later mark of the line is tried in vain
TO_DO = rf"(?i){PLANNED}[:\s]++.*?(?:(?<![\w.-])[.-]*+(\w[\w.-]*-(?:service|api|db|cache|queue|broker|cluster)[\w.-]*+)|(?=(?:{PLANNED}[:\s]*)?[\n\r\x85\u2028\u2029])|\z)"
ADDRESS = r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+://[^\s,;)\"']++)"
COMMENT_SCHEMES = {
    "postgres": "database", "postgresql": "database", "mysql": "database", "mongodb": "database", "mongodb+srv": "database", "redis": "cache", "rediss": "cache",
    "amqp": "message-broker", "amqps": "message-broker", "nats": "message-broker", "http": "service", "https": "service",
}
COMMENT_HOSTS = (
    "example.com", "example.org", "example.net", "localhost", "127.0.0.1", "0.0.0.0", "docs.python.org", "docs.go.dev", "developer.mozilla.org", "github.com", "stackoverflow.com",
    "en.wikipedia.org", "www.example.com",
)
# Words and endings that are no component's name.
NOISE_WORDS = (
    "the a an this that it its they them their we our you your all any each every some non new old same other more most only own for from with into here there where when then also "
    "not but and data value result error input output file path name type list map set get run test true false null nil made just been being both well still done used called given "
    "based needed required pagination information configuration implementation documentation"
).split()
NOISE_ENDINGS = ("com", "io", "org", "net", "dev", "app", "co", "cloud", "ai")
# Parts of Terraform addresses and host names without a meaning of their own.
PLAIN_PARTS = "aws instance cluster group internal local default main this module data resource replication terraform provider".split()
ENV_CONFIDENCE, TFVARS_CONFIDENCE = 0.7, 0.65
SIGNAL = ("source_component", "target_component", "target_type", "signal_type", "confidence", "evidence", "file_path", "line_number", "language")


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])[key]


def language(path: Column) -> Column:
    return _lookup(LANGUAGES, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def is_test(path: Column, language: Column) -> Column:
    """Whether a file's name is one of its language's tests, or Terraform's own copy of a provider."""
    base = F.element_at(F.split(path, r"[/\\]"), -1)
    return (
        ((language == "go") & F.endswith(base, F.lit("_test.go")))
        | ((language == "python") & F.regexp(base, F.lit(r"^test_.*\.py$|_test\.py$|^conftest\.py$")))
        | ((language == "javascript") & F.regexp(base, F.lit(r"\.(?:test|spec)\.")))
        | ((language == "terraform") & F.regexp(path, F.lit(r"(?:^|[/\\])\.terraform[/\\]")))
    )


def is_connection_variable(name: Column) -> Column:
    return F.regexp(F.upper(name), F.lit(f"(?:{'|'.join(CONNECTION_SUFFIXES)})$|^(?:{'|'.join(CONNECTION_PREFIXES)})"))


def variable_type(name: Column, language: Column) -> Column:
    family = F.substring_index(F.upper(name), "_", 1)
    more = F.when(language == "go", _lookup(GO_VARIABLE_TYPES, family))
    return F.coalesce(_lookup(VARIABLE_TYPES, family), more, F.lit("unknown"))


def is_noise(name: Column) -> Column:
    """Names under three characters, web domains and common words, which are no components."""
    lower = F.lower(name)
    domain = F.contains(lower, F.lit(".")) & ~F.contains(lower, F.lit("/")) & F.substring_index(lower, ".", -1).isin(*NOISE_ENDINGS)
    return (F.length(name) < 3) | domain | lower.isin(*NOISE_WORDS)


def catalog(spark: SparkSession) -> DataFrame:
    """The known calls: ``language, library, function, made, kind, target_type, score, argument, fallback``."""

    def of(table: dict, library: str, function: str, other):
        return table.get(f"{library}.{function}", table.get(library, other))

    def last(library: str) -> str:
        parts = library.split("/")
        return parts[-2] if len(parts) > 1 and parts[-1][:1] == "v" and parts[-1][1:2].isdigit() else parts[-1]

    rows = [
        (lang, lib, f, form == "new", kind, t, of(CALL_CONFIDENCE, lib, f, KIND_CONFIDENCE.get(kind, 0.85)), of(ARGUMENT, lib, f, 0 if kind == "http_call" else -1), FALLBACK.get(lib, last(lib) if lang == "go" else lib))
        for lang, lib, f, form, kind, t in CALLS
    ]
    return spark.createDataFrame(rows, "language string, library string, function string, made boolean, kind string, target_type string, score double, argument int, fallback string")


def resolved(files: DataFrame) -> DataFrame:
    """Calls with the library they belong to: ``src, path, language, library, function, made, line, evidence, args``."""
    known = F.map_from_entries(F.transform("imports", lambda i: F.struct(i["local"], F.struct(i["library"], i["name"]))))
    rows = files.select("src", "path", "language", F.explode("calls").alias("c"), known.alias("known")).where(F.col("c.form") != "decorator")
    whole = F.try_element_at("known", F.coalesce("c.object", "c.function"))
    made = (F.col("language") == "javascript") & (F.col("c.form") == "new")
    bare = F.col("c.object").isNull()
    rows = rows.withColumns({"i": whole, "made": made, "bare": bare})
    # a bare call needs a name that was imported; JavaScript has default imports, which are called by their local name, and fetch
    by_name = F.coalesce("i.name", F.when(F.col("language") == "javascript", F.col("c.function")))
    library = F.when((F.col("language") == "javascript") & bare & (F.col("c.function") == "fetch"), F.coalesce("i.library", F.lit(""))).when(bare & by_name.isNull(), None).when((F.col("language") == "go") & bare, None).otherwise(F.col("i.library"))
    function = F.when(bare, F.coalesce(by_name, "c.function")).otherwise(F.col("c.function"))
    out = rows.select("src", "path", "language", library.alias("library"), function.alias("function"), "made", F.col("c.line").alias("line"), F.col("c.evidence").alias("evidence"), F.col("c.args").alias("args"))
    return out.where(F.col("library").isNotNull())


def call_signals(files: DataFrame) -> DataFrame:
    hit = resolved(files).join(F.broadcast(catalog(files.sparkSession)), ["language", "library", "function", "made"])  # a catalog of fixed size
    first = F.get("args", F.lit(0))["value"]
    keyword = lambda name: F.get(F.filter("args", lambda a: a["name"] == name), F.lit(0))["value"]
    literal = lambda at: F.get(F.filter("args", lambda a: (a["at"] == at) & a["whole"]), F.lit(0))["value"]
    host = lambda x: F.nullif(connection_target(F.trim(x)), F.lit(""))
    named = F.coalesce(keyword("host"), host(keyword("bootstrap_servers")), keyword("bootstrap_servers"))
    python = (
        F.when((F.col("library") == "boto3") & (F.col("function") == "client"), F.when(F.exists("args", lambda a: a["value"] == "sqs"), "sqs").otherwise(""))
        .when(F.col("library") == "pika", F.coalesce(first, "fallback"))
        .when(F.col("argument") >= 0, F.coalesce(host(first), first, "fallback"))
        .otherwise(F.coalesce(named, host(first), first, "fallback"))
    )
    given = literal(F.col("argument"))
    driver = F.when((F.col("kind") == "db_connection") & (F.col("argument") == 1), literal(F.lit(0)))
    go = F.coalesce(host(given), driver, "fallback")
    script = F.coalesce(F.when(F.col("argument") >= 0, host(first)), "fallback")
    target = F.when(F.col("language") == "python", python).when(F.col("language") == "go", go).otherwise(script)
    better = F.when((F.col("language") == "go") & host(given).isNotNull(), F.nullif(connection_type(F.trim(given)), F.lit("unknown")))
    rows = hit.withColumn("target", target).withColumn("better", better).where(F.col("target") != "")
    return rows.select(
        F.col("src").alias("source_component"), F.col("target").alias("target_component"), F.coalesce("better", "target_type").alias("target_type"), F.col("kind").alias("signal_type"),
        F.col("score").alias("confidence"), "evidence", F.col("path").alias("file_path"), F.col("line").alias("line_number"), "language",
    )


def decorator_signals(files: DataFrame) -> DataFrame:
    """Routes of Python web frameworks: ``@app.route`` is Flask's, other methods count as FastAPI's."""
    rows = files.where(F.col("language") == "python").select("src", "path", "language", F.explode("calls").alias("c")).where((F.col("c.form") == "decorator") & F.col("c.object").isNotNull())
    route = F.col("c.function") == "route"
    rows = rows.where(F.col("c.function").isin("route", "get", "post", "put", "delete", "patch"))
    return rows.select(
        F.col("src").alias("source_component"), F.when(route, "flask-app").otherwise("fastapi-app").alias("target_component"), F.lit("service").alias("target_type"), F.lit("http_server").alias("signal_type"),
        F.when(route, 0.9).otherwise(0.85).alias("confidence"), F.col("c.evidence").alias("evidence"), F.col("path").alias("file_path"), F.col("c.line").alias("line_number"), "language",
    )


def comment_signals(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Dependencies that comments state, plan (TODO and the like) or link to; each target once a line.

    Stated and linked ones have confidence 0.4, or 0.5 where ``known(name)`` has them; planned ones 0.3.
    """
    rows = files.select("src", "path", "language", F.explode("comments").alias("c"))
    every = lambda pattern: F.regexp_extract_all("c.text", F.lit(pattern), F.lit(1))
    found = lambda values, order, target, kind: F.transform(values, lambda v: F.struct(F.lit(order).alias("order"), target(v).alias("target"), kind(v).alias("type")))
    same, unknown = lambda v: v, lambda v: F.lit("unknown")
    address = F.filter(every(ADDRESS), lambda v: ~F.regexp_extract(v, HOST_OF, 1).isin("", *COMMENT_HOSTS))
    hits = F.concat(
        found(every(STATED), 1, same, unknown), found(F.filter(every(TO_DO), lambda v: v != ""), 2, same, unknown),
        found(address, 3, lambda v: F.regexp_extract(v, HOST_OF, 1), lambda v: F.coalesce(_lookup(COMMENT_SCHEMES, F.substring_index(v, "://", 1)), F.lit("unknown"))),
    )
    each = rows.select("src", "path", "language", F.col("c.line").alias("line"), F.col("c.evidence").alias("evidence"), F.explode(hits).alias("x"))
    best = each.groupBy("src", "path", "language", "line", F.col("x.target").alias("target")).agg(F.min(F.struct("x.order", "x.type", "evidence")).alias("x"))
    if known is not None:
        best = best.join(known.select(F.col("name").alias("target"), F.lit(True).alias("is_known")).distinct(), "target", "left")
    else:
        best = best.withColumn("is_known", F.lit(False))
    score = F.when(F.col("x.order") == 2, 0.3).when(F.coalesce("is_known", F.lit(False)), 0.5).otherwise(0.4)
    return best.select(
        F.col("src").alias("source_component"), F.col("target").alias("target_component"), F.col("x.type").alias("target_type"), F.lit("comment_hint").alias("signal_type"),
        score.alias("confidence"), F.col("x.evidence").alias("evidence"), F.col("path").alias("file_path"), F.col("line").alias("line_number"), "language",
    )


HOST_OF = r"://(?:[^@/]*@)?([^:/?#]+)"


def variable_signals(files: DataFrame) -> DataFrame:
    rows = files.select("src", "path", "language", F.explode("variables").alias("v")).where(is_connection_variable(F.col("v.name")))
    return rows.select(
        F.col("src").alias("source_component"), F.col("v.name").alias("target_component"), variable_type(F.col("v.name"), F.col("language")).alias("target_type"), F.lit("env_var_ref").alias("signal_type"),
        F.lit(ENV_CONFIDENCE).alias("confidence"), F.col("v.evidence").alias("evidence"), F.col("path").alias("file_path"), F.col("v.line").alias("line_number"), "language",
    )


def terraform_signals(files: DataFrame) -> DataFrame:
    """Resources, data sources, modules, dependencies and references of Terraform files; each kind and target once a file."""
    rows = files.where(F.col("language") == "terraform").select("src", "path", "language", F.explode("blocks").alias("b")).select("src", "path", "language", "b.*")
    prefixes = F.array(*[F.struct(F.lit(k).alias("prefix"), F.lit(t).alias("type"), F.lit(c).alias("score")) for k, (t, c) in RESOURCES.items()])
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(t).alias("type")) for k, t in MODULES.items()])
    module = F.col("kind") == "module"
    of = F.when(~module, F.get(F.filter(prefixes, lambda r: F.startswith(F.lower("type"), r["prefix"])), F.lit(0)))
    source = F.when(module, F.get(F.filter(parts, lambda r: F.contains(F.lower("type"), r["part"])), F.lit(0)))
    rows = rows.withColumn("of", of).withColumn("source", source).where(module | F.col("of").isNotNull())
    score = (
        F.when(module, F.when(F.col("source").isNotNull(), 0.8).otherwise(0.6))
        .when(F.col("kind") == "dependency", 0.9).when(F.col("kind") == "ref", 0.75).when(F.col("kind") == "data", F.round(F.col("of.score") * 0.85, 4)).otherwise(F.col("of.score"))
    )
    kind = F.concat(F.lit("terraform_"), F.when(F.col("kind") == "data", "data_source").otherwise(F.col("kind")))
    out = rows.select(
        F.col("src").alias("source_component"), F.when(module, F.col("label")).otherwise(F.concat_ws(".", "type", "label")).alias("target_component"),
        F.coalesce("source.type", "of.type", F.lit("service")).alias("target_type"), kind.alias("signal_type"), score.alias("confidence"), "evidence", F.col("path").alias("file_path"), F.col("line").alias("line_number"), "language",
    )
    first = Window.partitionBy("source_component", "file_path", "signal_type", "target_component").orderBy("line_number", F.desc("confidence"))
    return out.withColumn("at", F.row_number().over(first)).where("at = 1").drop("at")


def tfvars_signals(files: DataFrame) -> DataFrame:
    """Hosts among the quoted values of ``.tfvars`` files."""
    rows = files.where(F.regexp(F.col("path"), F.lit(r"\.tfvars(?:\.json)?$")) & ~F.contains("path", F.lit(".terraform/")))
    lines = rows.select("src", "path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).withColumn("line", F.trim("line"))
    value = F.regexp_extract("line", r'=\s*"([^"]+)"', 1)
    found = lines.where(~F.startswith("line", F.lit("#"))).withColumn("value", F.trim(value)).withColumn("host", connection_target(F.col("value"))).where("host != ''")
    return found.select(
        F.col("src").alias("source_component"), F.col("host").alias("target_component"), connection_type(F.col("value")).alias("target_type"), F.lit("env_var_ref").alias("signal_type"),
        F.lit(TFVARS_CONFIDENCE).alias("confidence"), F.col("line").alias("evidence"), F.col("path").alias("file_path"), (F.col("pos") + 1).cast("int").alias("line_number"), F.lit("terraform").alias("language"),
    )


def signals(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Signals of ``src, path, content`` files in the schema of ``CODE_SIGNALS``; test files are left out.

    ``known(name)`` are components whose mention in a comment counts more.  Null contents
    and unknown languages give nothing; repeated files give repeated signals.
    """
    lang = language(F.col("path"))
    code = files.where(lang.isNotNull() & F.col("content").isNotNull()).withColumn("language", lang).where(~is_test(F.col("path"), F.col("language")))
    told = checkpointed(scanned(code))
    parts = [call_signals(told), decorator_signals(told), comment_signals(told, known), variable_signals(told), terraform_signals(told), tfvars_signals(files), gomod_signals(files)]
    return reduce(DataFrame.unionByName, parts).select(*SIGNAL)


def edges(found: DataFrame) -> DataFrame:
    """Best confidence per (source, target) and the number of signals; names that are noise give none."""
    kept = found.where((F.col("source_component") != F.col("target_component")) & ~is_noise(F.col("target_component")) & ~is_noise(F.col("source_component")))
    return kept.groupBy(F.col("source_component").alias("src"), F.col("target_component").alias("dst")).agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("evidence"))


def name_parts(name: Column) -> Column:
    parts = F.split(F.regexp_replace(F.lower(name), r"[._/-]+", " "), r"\s+")
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) >= 2) & ~p.isin(*PLAIN_PARTS)))


def cross_referenced(found: DataFrame) -> DataFrame:
    """``source_component, src, dst, confidence``: targets of code that stand for a Terraform resource.

    Within one source component and one type: a target that a ``.tfvars`` value names
    goes to the only resource of its type or the best match of names (0.8); else the
    best match decides, 0.7 from half of the words of the shorter name on, 0.55 from
    0.3; else the only resource of the type (0.6).  A tie of best matches decides
    nothing.  Names meet by an equi-join on their words.
    """
    kept = found.where(~F.col("target_type").isin("", "unknown") & (F.col("target_component") != "") & (F.col("target_component") != F.col("source_component")))
    typed = checkpointed(kept.select("source_component", "target_component", "target_type", "signal_type", "file_path", "line_number", "language"))  # read three times
    own, place = "source_component", F.struct("file_path", "line_number", "signal_type", "target_type")
    terraform = F.col("language") == "terraform"
    variable = F.col("signal_type") == "env_var_ref"
    kind = F.min_by("target_type", place).alias("type")
    resources = checkpointed(typed.where(terraform & ~variable).groupBy(own, F.col("target_component").alias("dst")).agg(kind))
    hosts = typed.where(terraform & variable).select(own, F.col("target_component").alias("src"), F.lit(True).alias("in_values")).distinct()
    targets = typed.where(~terraform).groupBy(own, F.col("target_component").alias("src")).agg(kind)
    targets = checkpointed(targets.join(resources.withColumnRenamed("dst", "src").select(own, "src"), [own, "src"], "left_anti").join(hosts, [own, "src"], "left"))
    alone = resources.groupBy(own, "type").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("only"))
    words = lambda df, name: df.select(own, "type", name, F.size(name_parts(F.col(name))).alias(f"{name}_words"), F.explode(name_parts(F.col(name))).alias("word"))
    shared = words(targets, "src").join(words(resources, "dst"), [own, "type", "word"]).groupBy(own, "type", "src", "dst").agg((F.count(F.lit(1)) / F.least(F.max("src_words"), F.max("dst_words"))).alias("score"))
    best = shared.groupBy(own, "src").agg(F.max(F.struct("score", "dst")).alias("x"), F.max("score").alias("score"), F.collect_list("score").alias("scores"))
    best = best.where(F.size(F.filter("scores", lambda s: s == F.col("score"))) == 1).select(own, "src", "score", F.col("x.dst").alias("match"))
    rows = targets.join(alone, [own, "type"]).join(best, [own, "src"], "left")
    only, match = F.when(F.col("n") == 1, F.col("only")), lambda least: F.when(F.col("score") >= least, F.col("match"))
    by_value = F.when(F.col("in_values"), F.coalesce(only, F.when(F.col("n") > 1, match(0.3))))
    dst = F.coalesce(by_value, match(0.3), only)
    score = F.when(by_value.isNotNull(), 0.8).when(match(0.5).isNotNull(), 0.7).when(match(0.3).isNotNull(), 0.55).otherwise(0.6)
    return rows.select(own, "src", dst.alias("dst"), score.alias("confidence")).where(F.col("dst").isNotNull())
