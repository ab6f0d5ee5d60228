import time

import pytest
from pyspark.sql import functions as F

from depgrove.operators import codescan, lexing

FILES = "src string, path string, content string"


def told(spark, path, *lines, known=None):
    """(line, target, type, kind, confidence) of one file."""
    found = codescan.signals(spark.createDataFrame([("s", path, "\n".join(lines))], FILES), known)
    return sorted((r["line_number"], r["target_component"], r["target_type"], r["signal_type"], round(r["confidence"], 4)) for r in found.collect())


def test_python_aliases_strings_and_docstrings(spark):
    assert told(
        spark, "a.py", "import requests as req, psycopg2", "from redis import Redis as R", "x = 'req.get(\"http://quoted\")'  # R(host='old')", "'''req.get('http://doc')", "R('x')", "'''",
        "req.post(", "    url(f('http://a-1/x')),", ")", "c = R(port=1, host='real')", "psycopg2.connect(dsn)", "def req(): pass", "get('http://bare')",
    ) == [(4, "doc", "service", "comment_hint", 0.4), (7, "a-1", "service", "http_call", 0.9), (10, "real", "cache", "cache_client", 0.85), (11, "psycopg2", "database", "db_connection", 0.85)]


def test_go_aliases_drivers_and_fallbacks(spark):
    assert told(
        spark, "m.go", "import (", '  pg "database/sql"', '  "github.com/jackc/pgx/v5/pgxpool"', ")", 'import "google.golang.org/grpc"', 'pg.Open("postgres", "host=db-1 port=5")', "pg.Open(\"mysql\", x)",
        "pgxpool.New(ctx, os.Getenv(name))", 'grpc.DialContext(ctx, "rpc-1:80")', 'sql.Open("postgres", "host=db-9")', "s := `grpc.Dial(\"no:1\")`", 'grpc.Dial("a:1" + b)',
    ) == [
        (6, "db-1", "database", "db_connection", 0.85), (7, "mysql", "database", "db_connection", 0.85), (8, "postgresql", "database", "db_connection", 0.9),
        (9, "rpc-1", "service", "http_call", 0.9), (12, "grpc", "service", "http_call", 0.9),
    ]


def test_javascript_imports_of_every_form(spark):
    assert told(
        spark, "i.tsx", "import pgs, { Pool as P, Client } from 'pg'", 'const { createPool: make } = require("mysql2")', "let knex = require('knex')", "// axios.get('http://no')", "new P(); new Client()", "make('mysql://m-1/x')",
        "knex({})", "P()", "axios.get('http://unimported')", "const text = 'fetch(1)'; fetch(`http://f-1/${x}`)", "it.fetch('http://no')",
    ) == [
        (4, "no", "service", "comment_hint", 0.4), (5, "pg", "database", "db_connection", 0.85), (5, "pg", "database", "db_connection", 0.85), (6, "m-1", "database", "db_connection", 0.85),
        (7, "knex", "database", "db_connection", 0.85), (10, "f-1", "service", "http_call", 0.9),
    ]


def test_comments_state_plan_and_link(spark):
    known = spark.createDataFrame([("auth-service",)], "name string")
    assert told(
        spark, "c.go", "// calls auth-service and calls auth-service", "x := 1 // TODO: use the new-user-db soon", "/* reads from a.b.c.", " * FIXME nothing", " * see redis://kv-1:1/x and https://github.com/x", " */", 's := "// uses nothing-api"',
        known=known,
    ) == [(1, "auth-service", "unknown", "comment_hint", 0.5), (2, "new-user-db", "unknown", "comment_hint", 0.3), (3, "a.b.c", "unknown", "comment_hint", 0.4), (5, "kv-1", "cache", "comment_hint", 0.4)]


def test_terraform_depth_lists_and_references(spark):
    assert told(
        spark, "x/main.tf", 'resource "aws_db_instance" "a" {', "  depends_on = [aws_sqs_queue.q, random_id.r]", "  nested {", "    depends_on = [aws_lb.front]", "    host = aws_db_instance.b.address", "    again = aws_db_instance.b.port", "  }", "}",
        'module "m" {', '  inner { source = "terraform-aws-modules/rds" }', "}", 'data "aws_lambda_function" "f" {', "}", 'resource "aws_unknown" "u" {', "  x = kubernetes_service.api.id # aws_elb.no is read too", "}",
    ) == [
        (1, "aws_db_instance.a", "database", "terraform_resource", 0.92), (2, "aws_sqs_queue.q", "queue", "terraform_dependency", 0.9), (4, "aws_lb.front", "load-balancer", "terraform_ref", 0.75),
        (5, "aws_db_instance.b", "database", "terraform_ref", 0.75), (12, "aws_lambda_function.f", "service", "terraform_data_source", 0.782), (15, "aws_elb.no", "load-balancer", "terraform_ref", 0.75),
        (15, "kubernetes_service.api", "service", "terraform_ref", 0.75),
    ]
    assert told(spark, ".terraform/m.tf", 'resource "aws_lb" "x" {') == []


def test_modules_that_a_manifest_requires(spark):
    assert told(spark, "x/go.mod", "require (", "  k8s.io/client-go v0.1.0", "  github.com/jackc/pgxx v1.0.0", '  "github.com/IBM/sarama" v1.2.3+incompatible', ")", "require github.com/aws/aws-sdk-go v1.0.0", "require()", "exclude (", " gorm.io/gorm v1.0.0", ")") == [
        (2, "kubernetes", "orchestrator", "sdk_import", 0.85), (4, "kafka", "message-broker", "sdk_import", 0.9), (6, "aws", "cloud-platform", "sdk_import", 0.7),
    ]
    assert told(spark, "go.mod", "") == [] and told(spark, "not-go.mod", "require gorm.io/gorm v1.0.0") == []


def test_files_that_are_tests_null_or_unknown_give_nothing(spark):
    code = "import requests\nrequests.get('http://a-1')"
    paths = ["test_a.py", "a_test.py", "conftest.py", "x/a.spec.ts", "a.test.js", "a_test.go", "a.rb", "noextension"]
    rows = [("s", p, code) for p in paths] + [("s", "null.py", None), ("s", "empty.py", ""), ("s", None, code)]
    assert codescan.signals(spark.createDataFrame(rows, FILES)).collect() == []
    assert codescan.signals(spark.createDataFrame([("s", "ok.py", code), ("s", "ok.py", code)], FILES)).count() == 2


def test_noise_gives_no_edges(spark):
    rows = [("svc", "a.go", "// uses the x, calls db-1, depends on api.example.io, uses it"), ("svc", "b.go", "// calls svc")]
    assert [(r["dst"], r["evidence"]) for r in codescan.edges(codescan.signals(spark.createDataFrame(rows, FILES))).collect()] == [("db-1", 1)]


def test_cross_reference_stages(spark):
    signal = lambda target, kind, lang="go", form="x", n=1: ("s", target, kind, form, 0.9, "", "f", n, lang)
    rows = [
        signal("aws_db_instance.orders", "database", "terraform"), signal("aws_db_instance.users", "database", "terraform"), signal("aws_sqs_queue.jobs", "queue", "terraform"), signal("aws_lb.front_web", "load-balancer", "terraform"),
        signal("db.internal", "database", "terraform", "env_var_ref"), signal("orders-db", "database"), signal("db.internal", "database"), signal("work", "queue"), signal("aws_lb.front_web", "load-balancer"), signal("other", "unknown"),
        signal("web-a-b-cc", "load-balancer"), signal("users.orders", "database"), signal("s", "queue"),
    ]
    found = codescan.cross_referenced(spark.createDataFrame(rows, ", ".join(f"{c} {'double' if c == 'confidence' else 'int' if c == 'line_number' else 'string'}" for c in codescan.SIGNAL)))
    # db.internal shares "db" with both databases, users.orders a word with each: ties decide nothing
    assert sorted((r["src"], r["dst"], r["confidence"]) for r in found.collect()) == [("orders-db", "aws_db_instance.orders", 0.7), ("web-a-b-cc", "aws_lb.front_web", 0.7), ("work", "aws_sqs_queue.jobs", 0.6)]


@pytest.mark.parametrize("language", ["python", "go", "javascript", "terraform"])
@pytest.mark.parametrize("run", ["a", " ", "\n", "(", '"', "`", "a.", "'''", "/*", "#", "new ", "$A", "a(", "import ", "{ "])
def test_long_runs_take_linear_time(language, run):
    begin = time.process_time()
    lexing.scan(language, run * (100_000 // len(run)))
    assert time.process_time() - begin < 2


def test_long_comments_take_linear_time(spark):
    rows = [("s", "a.py", "# " + run * (300_000 // len(run))) for run in ("a", "a.", "a-", "TODO ", "uses a.", "x-db.", "http://", "-service ")]
    assert codescan.signals(spark.createDataFrame(rows, FILES)).agg(F.count(F.lit(1))).first()[0] > 0
