"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from depgrove.plans.queries import INDEX_TERMS, LEXICON, PART, TERMS
from depgrove.sources.derived import SOURCES


def _tier(x: str) -> str:
    return f"CASE WHEN {x} >= 0.95 THEN 'explicit' WHEN {x} >= 0.75 THEN 'strong-inference' WHEN {x} >= 0.55 THEN 'moderate' WHEN {x} >= 0.45 THEN 'weak' WHEN {x} >= 0.42 THEN 'semantic' ELSE 'threshold' END"


PART_EDGES = """pairs AS (SELECT l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS d FROM lineitem),
    edges AS (SELECT 'part-' || s AS src, 'part-' || d AS dst, count(*) AS n, round(1 - pow(0.5, count(*)), 6) AS confidence FROM pairs WHERE d IS NOT NULL AND s <> d GROUP BY s, d)"""
EVENT_EDGES = """pairs AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
    counted AS (SELECT src, dst, count(*) AS n FROM pairs WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst),
    edges AS (SELECT src, dst, n, round(0.5 + 0.5 * n / sum(n) OVER (PARTITION BY src), 6) AS confidence FROM counted)"""
ENTITIES = """nodes AS (SELECT 'nation-' || n_nationkey AS id, n_name AS title, 'gateway' AS component_type FROM nation
        UNION ALL SELECT 'supplier-' || s_suppkey, s_name, 'database' FROM supplier UNION ALL SELECT 'customer-' || c_custkey, c_name, 'service' FROM customer),
    edges AS (SELECT 'supplier-' || s_suppkey AS src, 'nation-' || s_nationkey AS dst, 'references' AS type, round(0.4 + (floor(abs(s_acctbal))::BIGINT % 60) / 100, 6) AS confidence FROM supplier
        UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey, 'references', round(0.4 + (floor(abs(c_acctbal))::BIGINT % 60) / 100, 6) FROM customer)"""
DEGREES = """ends AS (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges), degrees AS (SELECT id, sum(i)::BIGINT AS incoming_edges, sum(o)::BIGINT AS outgoing_edges FROM ends GROUP BY id)"""
SIGNALS = """signals AS (SELECT 'supplier-' || l_suppkey AS src, 'part-' || l_partkey AS dst,
        CASE l_returnflag WHEN 'A' THEN 'code' WHEN 'R' THEN 'structural' ELSE 'cooccurrence' END AS algorithm, round(0.4 + 5 * l_discount, 6) AS confidence,
        CASE l_linestatus WHEN 'O' THEN 'depends-on' ELSE 'calls' END AS type, 'order-' || l_orderkey AS evidence, l_tax * 20 AS weight FROM lineitem)"""
WEIGHT = "CASE algorithm WHEN 'cooccurrence' THEN 0.3::DOUBLE WHEN 'ner' THEN 0.5 WHEN 'structural' THEN 0.6 WHEN 'semantic' THEN 0.7 WHEN 'code' THEN 0.85 WHEN 'llm' THEN 1.0 ELSE 0.5 END"
DOCS = f"""{PART_EDGES},
    rows AS (SELECT src, dst, src || ' ' || CASE n % 4 WHEN 0 THEN 'depends on' WHEN 1 THEN 'calls' WHEN 2 THEN 'uses' ELSE 'reads from' END || ' ' || dst || '.' AS prose, '- [' || dst || '](./' || dst || '.md)' AS item FROM edges),
    docs AS (SELECT src AS doc_id, 'docs/' || src || '.md' AS path, '# ' || src || chr(10) || chr(10) || 'Overview.' || chr(10) || chr(10) || '## Dependencies' || chr(10) || chr(10)
        || string_agg(item, chr(10) ORDER BY dst) || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) || string_agg(prose, chr(10) ORDER BY dst) || chr(10) AS text FROM rows GROUP BY src)"""
# Fixed values, kept apart from the operators' own.
STOP_WORDS = (
    "a an and are as at be been being but by can could do does did for from had has have he her here him his how i if in into is it its just "
    "me my no not now of on or our s she should so some than that the their them then there these they this those through to too up use "
    "was we were what when where which while who will with would you your"
).split()
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{Nd}}]+(?:-[\p{{L}}\p{{Nd}}]+)*'), lambda t: length(t) >= 2 AND t NOT IN ({STOP}))"


def _walk(near: str, far: str, depth: int, where: str = "true") -> str:
    """Reach from PART with the least discovering edge, as the BFS does it."""
    return f"""WITH RECURSIVE {PART_EDGES}, e AS (SELECT * FROM edges WHERE {where}),
    walk(id, distance) AS (SELECT '{PART}', 0 UNION SELECT e.{far}, w.distance + 1 FROM walk w JOIN e ON e.{near} = w.id WHERE w.distance < {depth}),
    reached AS (SELECT id, min(distance) AS distance FROM walk GROUP BY id),
    found AS (SELECT r.id, r.distance, e.{near} AS via, e.confidence, row_number() OVER (PARTITION BY r.id ORDER BY e.{near}) AS rn
        FROM e JOIN reached r ON r.id = e.{far} JOIN reached p ON p.id = e.{near} AND p.distance + 1 = r.distance)"""


PATHS = f"""WITH RECURSIVE {EVENT_EDGES}, paths(path, last, hops, confidence) AS (SELECT [src, dst], dst, 1, confidence FROM edges
    UNION ALL SELECT list_append(p.path, e.dst), e.dst, p.hops + 1, p.confidence * e.confidence FROM paths p JOIN edges e ON e.src = p.last WHERE NOT list_contains(p.path, e.dst) AND p.hops < 4)"""
CYCLES = f"""WITH RECURSIVE {EVENT_EDGES}, grow(path, first, last, n) AS (SELECT [src, dst], src, dst, 1 FROM edges WHERE dst > src
    UNION ALL SELECT list_append(g.path, e.dst), g.first, e.dst, g.n + 1 FROM grow g JOIN edges e ON e.src = g.last WHERE e.dst > g.first AND NOT list_contains(g.path, e.dst) AND g.n < 4),
    cycles AS (SELECT list_append(g.path, g.first) AS cycle, g.n + 1 AS length FROM grow g JOIN edges e ON e.src = g.last AND e.dst = g.first)"""
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {})"
LEX = ", ".join(f"'{x}'" for x in LEXICON)
# Suppliers by kind, each with its number in five digits and the documents of its neighbours, where they exist.
NAMED = """s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS m FROM supplier), z AS (SELECT k, m, lpad(k::VARCHAR, 5, '0') AS d,
        'docs/' || CASE m WHEN 0 THEN 'ledger-' || lpad(k::VARCHAR, 5, '0') || '-service' WHEN 1 THEN 'vault-' || lpad(k::VARCHAR, 5, '0') WHEN 2 THEN 'overview-' || lpad(k::VARCHAR, 5, '0') ELSE 'door_' || lpad(k::VARCHAR, 5, '0') END || '.md' AS path FROM s)"""
_near = lambda n: f"lpad((k + {n})::VARCHAR, 5, '0')"
EDITED = f"""{DOCS}, edited AS (SELECT doc_id, text || CASE WHEN doc_id LIKE '%5' THEN chr(10) || '### Cache' || chr(10) || chr(10) || 'redis cache, redis-cluster' || chr(10) ELSE '' END AS text FROM docs WHERE doc_id NOT LIKE '%7'
        UNION ALL SELECT 'new-' || doc_id, text FROM docs WHERE doc_id LIKE '%3'), {LINES.format('edited')},
    m AS (SELECT *, CASE WHEN starts_with(line, '### ') THEN 3 WHEN starts_with(line, '## ') THEN 2 WHEN starts_with(line, '# ') THEN 1 ELSE 0 END AS level FROM lines),
    s AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM m),
    chunks AS (SELECT doc_id, doc_id || '#' || replace(doc_id, 'new-', '') || CASE section WHEN 1 THEN '' WHEN 2 THEN ' > Dependencies' WHEN 3 THEN ' > Notes' ELSE ' > Notes > Cache' END || ':L' || (min(pos) + 1) AS chunk_id,
        {_tokens("string_agg(line, chr(10) ORDER BY pos)")} AS tokens FROM s GROUP BY doc_id, section)"""
HITS = "hits AS (SELECT doc_id, pos, line, unnest(list_distinct(" + _tokens("line") + ")) AS name FROM lines), named AS (SELECT * FROM hits WHERE name IN (" + LEX + "))"
# Fixed values, kept apart from the operators' own: keywords of the component types, and the types in canonical order.
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
ORDER = "service database cache queue message-broker load-balancer gateway storage container-registry config-server monitoring log-aggregator orchestrator secrets-manager search".split()
_keys = [(k, t) for t in ORDER for k in KEYWORDS[t]]
KEYS = ", ".join(f"({len(k)}, {i}, '{k}', '{t}')" for i, (k, t) in enumerate(_keys))
VERB_TYPE = "CASE verb WHEN 'depends on' THEN 'depends-on' WHEN 'calls' THEN 'calls' WHEN 'uses' THEN 'mentions' END"
VERB_SCORE = "CASE verb WHEN 'depends on' THEN 0.80::DOUBLE WHEN 'calls' THEN 0.75 WHEN 'uses' THEN 0.70 END"

# What each of the eight kinds of source files holds, told by hand: remainder of the key, file, line, target, type, kind, confidence.
TOLD = """told(m, file, line, target, type, kind, confidence) AS (VALUES
    (0, 'app.py', 2, 'nowhere-{k}', 'service', 'comment_hint', 0.4), (0, 'app.py', 6, 'cache-{k}', 'cache', 'cache_client', 0.85), (0, 'app.py', 11, 'api-{k}', 'service', 'http_call', 0.9),
    (0, 'app.py', 14, 'SERVICE_{k}_URL', 'unknown', 'env_var_ref', 0.7), (0, 'app.py', 15, 'billing-{k}-api', 'unknown', 'comment_hint', 0.4), (0, 'app.py', 15, 'doc-{k}', 'service', 'comment_hint', 0.4),
    (1, 'main.go', 10, 'ledger-{k}-service', 'unknown', 'comment_hint', 0.3), (1, 'main.go', 12, 'db-{k}', 'database', 'db_connection', 0.85), (1, 'main.go', 13, 'mysql', 'database', 'db_connection', 0.85),
    (1, 'main.go', 14, 'go-redis', 'cache', 'cache_client', 0.85), (1, 'main.go', 15, 'api-{k}', 'service', 'http_call', 0.9), (1, 'main.go', 17, 'SERVICE_{k}_URL', 'unknown', 'env_var_ref', 0.7),
    (1, 'main.go', 18, 'SLACK_TOKEN', 'notification', 'env_var_ref', 0.7),
    (2, 'index.ts', 5, 'axios.get', 'unknown', 'comment_hint', 0.4), (2, 'index.ts', 6, 'dead-{k}', 'database', 'comment_hint', 0.4), (2, 'index.ts', 7, 'pg', 'database', 'db_connection', 0.85),
    (2, 'index.ts', 7, 'DB_{k}_URL', 'database', 'env_var_ref', 0.7), (2, 'index.ts', 10, 'api-{k}', 'service', 'http_call', 0.9), (2, 'index.ts', 11, 'named-{k}', 'service', 'http_call', 0.9),
    (2, 'index.ts', 12, 'kafkajs', 'message-broker', 'queue_producer', 0.85), (2, 'index.ts', 13, 'plain-{k}', 'service', 'http_call', 0.9),
    (3, 'web.py', 3, 'audit-{k}', 'unknown', 'comment_hint', 0.4), (3, 'web.py', 8, 'flask', 'service', 'http_server', 0.9), (3, 'web.py', 10, 'flask-app', 'service', 'http_server', 0.9),
    (3, 'web.py', 14, 'fastapi-app', 'service', 'http_server', 0.85), (3, 'web.py', 16, 'broker-{k}', 'message-broker', 'queue_producer', 0.85), (3, 'web.py', 17, 'rabbit-{k}', 'message-broker', 'queue_producer', 0.85),
    (3, 'web.py', 19, 'topic', 'message-broker', 'queue_consumer', 0.85),
    (4, 'server.go', 4, 'gone-{k}', 'service', 'comment_hint', 0.4), (4, 'server.go', 5, 'store-{k}.main', 'unknown', 'comment_hint', 0.4), (4, 'server.go', 8, 'mq-{k}', 'message-broker', 'queue_producer', 0.85),
    (4, 'server.go', 9, 'http', 'service', 'http_call', 0.9), (4, 'server.go', 10, 'http', 'service', 'http_server', 0.95), (4, 'server.go', 10, 'the', 'unknown', 'comment_hint', 0.4),
    (4, 'go.mod', 2, 'redis', 'cache', 'sdk_import', 0.9), (4, 'go.mod', 5, 'aws-s3', 'storage', 'sdk_import', 0.9), (4, 'go.mod', 7, 'postgres', 'database', 'sdk_import', 0.85),
    (5, 'worker.js', 5, 'grid-{k}', 'unknown', 'comment_hint', 0.4), (5, 'worker.js', 7, 'hook-{k}', 'service', 'http_call', 0.9), (5, 'worker.js', 8, 'redis', 'cache', 'cache_client', 0.85),
    (5, 'worker.js', 9, 'docs-{k}', 'database', 'db_connection', 0.85), (5, 'worker.js', 11, 'KAFKA_BROKERS', 'message-broker', 'env_var_ref', 0.7),
    (6, 'main.tf', 2, 'aws_db_instance.orders_{k}', 'database', 'terraform_resource', 0.92), (6, 'main.tf', 5, 'aws_sns_topic.events', 'message-broker', 'terraform_dependency', 0.9),
    (6, 'main.tf', 10, 'bucket', 'storage', 'terraform_module', 0.8), (6, 'main.tf', 12, 'aws_elasticache_cluster.shared', 'cache', 'terraform_data_source', 0.782),
    (6, 'main.tf', 14, 'aws_lambda_function.worker', 'service', 'terraform_ref', 0.75), (6, 'main.tf', 16, 'aws_elasticache_replication_group.sessions', 'cache', 'terraform_resource', 0.92),
    (6, 'main.tf', 18, 'aws_sqs_queue.jobs', 'queue', 'terraform_ref', 0.75), (6, 'main.tf', 21, 'custom', 'service', 'terraform_module', 0.6),
    (6, 'prod.tfvars', 1, 'orders-{k}.internal', 'unknown', 'env_var_ref', 0.65), (6, 'prod.tfvars', 3, 'sessions-{k}', 'cache', 'env_var_ref', 0.65),
    (6, 'svc.py', 3, 'sessions-{k}', 'cache', 'cache_client', 0.85), (6, 'svc.py', 4, 'orders-db', 'database', 'db_connection', 0.85),
    (7, 'main.tf', 1, 'aws_sqs_queue.alpha', 'queue', 'terraform_resource', 0.92), (7, 'main.tf', 2, 'aws_sqs_queue.beta', 'queue', 'terraform_resource', 0.92),
    (7, 'main.tf', 3, 'aws_msk_cluster.stream', 'message-broker', 'terraform_resource', 0.92), (7, 'main.tf', 5, 'aws_lambda_function.report', 'service', 'terraform_resource', 0.92),
    (7, 'svc.py', 3, 'broker-{k}', 'message-broker', 'queue_producer', 0.85), (7, 'svc.py', 4, 'sqs', 'queue', 'queue_producer', 0.85), (7, 'svc.py', 5, 'lambda-worker-node', 'service', 'http_call', 0.9))"""
# The lines themselves are the query's input, which no table holds.
SOURCE_LINES = "SELECT * FROM (VALUES " + ", ".join("({}, '{}', {}, '{}')".format(m, name, n, line.replace("'", "''")) for m, files in SOURCES.items() for name, lines in files for n, line in enumerate(lines, 1)) + ") AS t(m, file, line, said)"
KEYS_OF = "k AS (SELECT s_suppkey AS k, 'supplier-' || s_suppkey AS src FROM supplier UNION ALL SELECT c_custkey, 'customer-' || c_custkey FROM customer)"
FILES = f"""{KEYS_OF}, {TOLD}, found AS (SELECT src, k, src || '/' || file AS path, line, replace(target, '{{k}}', k::VARCHAR) AS target, type, kind, confidence::DOUBLE AS confidence,
        CASE split_part(file, '.', 2) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'mod' THEN 'go' WHEN 'ts' THEN 'javascript' WHEN 'js' THEN 'javascript' ELSE 'terraform' END AS language FROM told JOIN k ON k.k % 8 = told.m)"""

RINGS = """ring AS (SELECT c_nationkey AS n, c_custkey AS k, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS next, min(c_custkey) OVER (PARTITION BY c_nationkey) AS low, max(c_custkey) OVER (PARTITION BY c_nationkey) AS high FROM customer),
    chain AS (SELECT s_nationkey AS n, s_suppkey AS k, lead(s_suppkey) OVER w AS next, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS back FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
    rings AS (SELECT 'customer-' || k AS src, 'customer-' || coalesce(next, low) AS dst FROM ring UNION ALL SELECT 'supplier-' || k, 'supplier-' || next FROM chain WHERE next IS NOT NULL
        UNION ALL SELECT 'supplier-' || c.k, 'customer-' || CASE WHEN back = 1 THEN low ELSE high END FROM chain c JOIN (SELECT DISTINCT n, low, high FROM ring) r ON r.n = c.n WHERE back <= 2)"""

ORACLES: dict[str, str] = {
    "impact_depth3": _walk("dst", "src", 3) + f" SELECT id AS name, distance, via, {_tier('confidence')} AS confidence_tier FROM found WHERE rn = 1",
    "dependencies_depth2_confident": _walk("src", "dst", 2, "confidence >= 0.5") + f" SELECT id AS name, distance, via, {_tier('confidence')} AS confidence_tier FROM found WHERE rn = 1",
    "dependencies_source_type": _walk("src", "dst", 2) + " SELECT id AS name, distance FROM found WHERE rn = 1",
    "closure_events": f"WITH RECURSIVE {EVENT_EDGES}, c(src, dst) AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM c JOIN edges e ON e.src = c.dst) SELECT src, dst FROM c",
    "reach_all": f"""WITH RECURSIVE {PART_EDGES}, e AS (SELECT src, dst FROM edges WHERE confidence > 0.5 UNION SELECT dst, src FROM edges WHERE confidence > 0.5),
        walk(id, distance) AS (SELECT '{PART}', 0 UNION SELECT e.dst, w.distance + 1 FROM walk w JOIN e ON e.src = w.id WHERE w.distance < 12) SELECT id, min(distance) AS distance FROM walk GROUP BY id""",
    "simple_paths_le4": f"{PATHS} SELECT array_to_string(path, '>') AS path, hops, round(confidence, 6) AS confidence FROM paths",
    "k_shortest_paths": f"""{PATHS}, ends AS (SELECT min(src) AS a, max(dst) AS b FROM edges),
        r AS (SELECT array_to_string(path, '>') AS route, hops, round(confidence, 6) AS confidence FROM paths, ends WHERE path[1] = a AND last = b)
        SELECT row_number() OVER (ORDER BY hops, route) AS rank, route, hops, confidence FROM r ORDER BY hops, route LIMIT 5""",
    "cycles_canonical": f"{CYCLES} SELECT array_to_string(cycle, '>') AS cycle, length FROM cycles",
    "cycle_edges": f"""{CYCLES}, hop AS (SELECT cycle, unnest(range(1, len(cycle))) AS i FROM cycles WHERE length <= 4) SELECT cycle[i] AS src, cycle[i + 1] AS dst, count(*) AS cycles FROM hop GROUP BY 1, 2""",
    "induced_subgraph": f"WITH {PART_EDGES}, inside AS (SELECT '{PART}' AS id UNION SELECT dst FROM edges WHERE src = '{PART}') SELECT src, dst, confidence FROM edges WHERE src IN (SELECT id FROM inside) AND dst IN (SELECT id FROM inside)",
    "crawl_two_starts": f"""WITH RECURSIVE {PART_EDGES}, e AS (SELECT * FROM edges WHERE confidence > 0.5),
        walk(id, depth) AS (SELECT unnest(['part-1', 'part-2']), 0 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.id WHERE w.depth < 2),
        reached AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id),
        up AS (SELECT r.id, string_agg(DISTINCT e.src, ',' ORDER BY e.src) AS parents FROM reached r JOIN e ON e.dst = r.id JOIN reached p ON p.id = e.src AND p.depth + 1 = r.depth GROUP BY r.id)
        SELECT r.id, r.depth, coalesce(u.parents, '') AS parents, (SELECT count(DISTINCT dst) FROM e WHERE e.src = r.id) AS edges_out FROM reached r LEFT JOIN up u ON u.id = r.id""",
    "crawl_backward": f"""WITH RECURSIVE {PART_EDGES}, e AS (SELECT * FROM edges WHERE confidence > 0.5), s AS (SELECT dst AS near, src AS far FROM e),
        walk(id, depth) AS (SELECT unnest(['part-1', 'part-2']), 0 UNION SELECT s.far, w.depth + 1 FROM walk w JOIN s ON s.near = w.id WHERE w.depth < 2),
        reached AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id),
        up AS (SELECT r.id, string_agg(DISTINCT s.near, ',' ORDER BY s.near) AS parents FROM reached r JOIN s ON s.far = r.id JOIN reached p ON p.id = s.near AND p.depth + 1 = r.depth GROUP BY r.id)
        SELECT r.id, r.depth, coalesce(u.parents, '') AS parents, (SELECT count(DISTINCT dst) FROM e WHERE e.src = r.id) AS edges_out FROM reached r LEFT JOIN up u ON u.id = r.id""",
    "crawl_both": f"""WITH RECURSIVE {PART_EDGES}, e AS (SELECT * FROM edges WHERE confidence > 0.5), s AS (SELECT dst AS near, src AS far FROM e UNION ALL SELECT src, dst FROM e),
        walk(id, depth) AS (SELECT unnest(['part-1', 'part-2']), 0 UNION SELECT s.far, w.depth + 1 FROM walk w JOIN s ON s.near = w.id WHERE w.depth < 2),
        reached AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id),
        up AS (SELECT r.id, string_agg(DISTINCT s.near, ',' ORDER BY s.near) AS parents FROM reached r JOIN s ON s.far = r.id JOIN reached p ON p.id = s.near AND p.depth + 1 = r.depth GROUP BY r.id)
        SELECT r.id, r.depth, coalesce(u.parents, '') AS parents, (SELECT count(DISTINCT dst) FROM e WHERE e.src = r.id) AS edges_out FROM reached r LEFT JOIN up u ON u.id = r.id""",
    "cycle_membership": f"""WITH RECURSIVE {EVENT_EDGES}, {RINGS}, every AS (SELECT src, dst FROM edges UNION SELECT src, dst FROM rings),
        walk(a, b) AS (SELECT src, dst FROM edges UNION SELECT w.a, e.dst FROM walk w JOIN edges e ON e.src = w.b),
        near AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component, count(*) + CASE WHEN bool_or(x.a = x.b) THEN 0 ELSE 1 END AS size FROM walk x JOIN walk y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
        nation AS (SELECT 'customer-' || c_custkey AS id, min('customer-' || c_custkey) OVER w AS component, count(*) OVER w AS size FROM customer WINDOW w AS (PARTITION BY c_nationkey)),
        ends AS (SELECT src AS id FROM every UNION SELECT dst FROM every)
        SELECT e.id, coalesce(n.component, c.component, e.id) AS component, coalesce(n.size, c.size, 1)::BIGINT AS size FROM ends e LEFT JOIN near n ON n.id = e.id LEFT JOIN nation c ON c.id = e.id""",
    "cyclic_dependencies": f"""WITH RECURSIVE {PART_EDGES}, e AS (SELECT DISTINCT src, dst FROM edges WHERE confidence > 0.5),
        walk(a, b) AS (SELECT src, dst FROM e UNION SELECT w.a, e.dst FROM walk w JOIN e ON e.src = w.b),
        mutual AS (SELECT x.a AS id, x.b AS other FROM walk x JOIN walk y ON y.a = x.b AND y.b = x.a),
        named AS (SELECT id, min(other) AS component FROM mutual GROUP BY id)
        SELECT e.src, e.dst, least(n.component, e.src) AS component FROM e JOIN mutual b ON b.id = e.src AND b.other = e.dst JOIN named n ON n.id = e.src""",
    "traversal_tags": f"""WITH RECURSIVE {EVENT_EDGES}, {RINGS}, every AS (SELECT src, dst FROM edges UNION ALL SELECT src, dst FROM rings),
        seen(id) AS (SELECT unnest(['supplier-1', 'supplier-2', 'view']) UNION SELECT e.dst FROM seen s JOIN every e ON e.src = s.id),
        walk(a, b) AS (SELECT src, dst FROM edges UNION SELECT w.a, e.dst FROM walk w JOIN edges e ON e.src = w.b)
        SELECT src, dst, CASE WHEN src LIKE 'customer-%' OR EXISTS (SELECT 1 FROM walk w WHERE w.a = e.dst AND w.b = e.src) THEN 'cyclic-dependency' ELSE 'direct-dependency' END AS relationship
        FROM every e WHERE src IN (SELECT id FROM seen)""",
    "crawl_cycle_classes": f"""WITH {RINGS}, n AS (SELECT c_nationkey AS n, count(*) AS size, min('customer-' || c_custkey) AS component, string_agg('customer-' || c_custkey, ',' ORDER BY 'customer-' || c_custkey) AS members FROM customer
            WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY 1)
        SELECT component, members, size, 'cross_branch' AS kind FROM n""",
    "documented_context": f"""WITH RECURSIVE {DOCS}, s AS (SELECT src AS near, dst AS far FROM edges UNION SELECT dst, src FROM edges),
        walk(id, depth) AS (SELECT '{PART}', 0 UNION SELECT s.far, w.depth + 1 FROM walk w JOIN s ON s.near = w.id WHERE w.depth < 2),
        reached AS (SELECT id, min(depth) AS distance FROM walk GROUP BY id),
        r AS (SELECT id, distance, text, length(text) AS size, coalesce(sum(length(text)) OVER (ORDER BY distance, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM reached JOIN docs ON doc_id = id)
        SELECT id, distance, least(size, 20000 - before)::BIGINT AS taken, md5(substr(text, 1, least(size, 20000 - before)::BIGINT)) AS digest, size > 20000 - before AS cut FROM r WHERE before < 20000""",
    "context_relations": f"""WITH {PART_EDGES}, n AS (SELECT '{PART}' AS id UNION SELECT dst FROM edges WHERE src = '{PART}' UNION SELECT src FROM edges WHERE dst = '{PART}')
        SELECT src AS id, dst AS other, 'depends_on' AS relation, confidence FROM edges WHERE src IN (SELECT id FROM n) UNION ALL SELECT dst, src, 'used_by', confidence FROM edges WHERE dst IN (SELECT id FROM n)""",
    "attenuated_reach": f"""WITH RECURSIVE {EVENT_EDGES}, e AS (SELECT * FROM edges WHERE confidence >= 0.3),
        walk(id, confidence, hops) AS (SELECT dst, confidence, 1 FROM e WHERE src = 'click' UNION ALL SELECT e.dst, w.confidence * e.confidence, w.hops + 1 FROM walk w JOIN e ON e.src = w.id WHERE w.hops < 3 AND w.confidence * e.confidence >= 0.3)
        SELECT id, round(max(confidence), 6) AS confidence FROM walk WHERE id <> 'click' GROUP BY id""",
    "degree_list": f"WITH {ENTITIES}, {DEGREES} SELECT n.id AS name, component_type AS type, coalesce(incoming_edges, 0) AS incoming_edges, coalesce(outgoing_edges, 0) AS outgoing_edges FROM nodes n LEFT JOIN degrees d ON d.id = n.id",
    "list_filtered": f"""WITH {ENTITIES}, {DEGREES} SELECT n.id AS name, component_type AS type, coalesce(incoming_edges, 0) AS incoming_edges, coalesce(outgoing_edges, 0) AS outgoing_edges FROM nodes n LEFT JOIN degrees d ON d.id = n.id
        WHERE component_type = 'database' AND EXISTS (SELECT 1 FROM edges e WHERE (e.src = n.id OR e.dst = n.id) AND e.confidence >= 0.75)""",
    "orphan_nodes": f"WITH {ENTITIES} SELECT id, component_type FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE confidence >= 0.9 UNION SELECT dst FROM edges WHERE confidence >= 0.9)",
    "dangling_edges": f"WITH {ENTITIES}, known AS (SELECT id FROM nodes WHERE title <> 'FRANCE' AND id NOT LIKE '%7') SELECT src, dst FROM edges WHERE src NOT IN (SELECT id FROM known) OR dst NOT IN (SELECT id FROM known)",
    "pruned_edges": f"WITH {ENTITIES}, known AS (SELECT id FROM nodes WHERE id NOT LIKE '%7') SELECT src, dst, confidence FROM edges WHERE src IN (SELECT id FROM known) AND dst IN (SELECT id FROM known)",
    "weak_only_nodes": f"WITH {ENTITIES}, ends AS (SELECT src AS id, confidence FROM edges UNION ALL SELECT dst, confidence FROM edges) SELECT id, max(confidence) AS best FROM ends GROUP BY id HAVING max(confidence) < 0.55",
    "tier_distribution": f"WITH {PART_EDGES} SELECT {_tier('confidence')} AS tier, count(*) AS edges, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM edges GROUP BY 1",
    "graph_stats": f"WITH {ENTITIES} SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, round(coalesce(avg(confidence) * 100, 0), 4) AS quality_score, count(DISTINCT type) AS edge_types FROM edges",
    "nodes_by_type": f"WITH {ENTITIES} SELECT component_type, count(*) AS nodes, min(id) AS first, max(id) AS last FROM nodes GROUP BY 1",
    "lifted_components": f"""WITH {PART_EDGES}, f AS (SELECT 'part-' || p_partkey AS file, p_brand AS component FROM part)
        SELECT a.component AS src, b.component AS dst, max(confidence) AS confidence, 'depends-on' AS type, count(*) AS evidence FROM edges JOIN f a ON a.file = src JOIN f b ON b.file = dst WHERE a.component <> b.component GROUP BY 1, 2""",
    "merged_sources": f"""WITH {PART_EDGES} SELECT src, dst, round(CASE WHEN n = 1 THEN confidence WHEN n = 2 THEN confidence ELSE 1 - (1 - confidence) * (1 - confidence) END, 6) AS confidence,
        CASE WHEN n = 1 THEN 'markdown' WHEN n = 2 THEN 'code' ELSE 'both' END AS source_type FROM edges""",
    "alias_rewrite": f"""WITH {PART_EDGES}, a AS (SELECT 'part-' || p_partkey AS alias, p_brand AS canonical FROM part WHERE p_partkey % 3 = 0),
        r AS (SELECT coalesce(x.canonical, src) AS src, coalesce(y.canonical, dst) AS dst, confidence FROM edges LEFT JOIN a x ON x.alias = src LEFT JOIN a y ON y.alias = dst)
        SELECT src, dst, 'depends-on' AS type, max(confidence) AS confidence FROM r WHERE src <> dst GROUP BY 1, 2""",
    "hypotheses_missing": f"WITH {ENTITIES} SELECT a.id AS src, b.id AS dst, 0.4::DOUBLE AS confidence FROM nodes a, nodes b WHERE a.component_type = 'database' AND b.component_type = 'gateway' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = a.id AND e.dst = b.id)",
    "valid_edges": f"WITH {PART_EDGES} SELECT src, count(*) AS edges FROM edges WHERE confidence >= 0.75 AND confidence <= 1 GROUP BY src",
    "merge_signals_max": f"WITH {SIGNALS}, r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY confidence DESC, type DESC, evidence DESC) AS rn, count(*) OVER (PARTITION BY src, dst) AS signals FROM signals) SELECT src, dst, confidence, type, evidence, signals FROM r WHERE rn = 1",
    "merge_signals_weighted": f"WITH {SIGNALS} SELECT src, dst, round(sum(confidence * {WEIGHT}) / sum({WEIGHT}), 6) AS confidence, count(*) AS signals FROM signals GROUP BY src, dst",
    "merge_signals_by_location": f"WITH {SIGNALS} SELECT src, dst, evidence, round(sum(confidence * {WEIGHT}) / sum({WEIGHT}), 6) AS confidence, count(*) AS signals FROM signals GROUP BY src, dst, evidence",
    "merge_signals_registry": f"WITH {SIGNALS} SELECT src, dst, round(least(1.0, max(confidence * CASE WHEN weight <= 0 THEN 1.0 ELSE weight END)), 6) AS confidence FROM signals GROUP BY src, dst",
    "merge_signals_hybrid": f"WITH {SIGNALS} SELECT src, dst, round(least(1.0, sum(confidence * {WEIGHT}) / sum({WEIGHT})), 6) AS confidence, count(*) AS signals FROM signals WHERE confidence >= 0.5 GROUP BY src, dst",
    "noisy_or_sources": f"""WITH {SIGNALS}, b AS (SELECT src, dst, max(confidence) FILTER (algorithm = 'code') AS c, max(confidence) FILTER (algorithm <> 'code') AS m FROM signals GROUP BY src, dst)
        SELECT src, dst, round(coalesce(1 - (1 - c) * (1 - m), c, m), 6) AS confidence, CASE WHEN c IS NULL THEN 'markdown' WHEN m IS NULL THEN 'code' ELSE 'both' END AS source_type FROM b""",
    "quality_gate": f"""WITH {SIGNALS}, s AS (SELECT src, dst, max(confidence) AS confidence, count(DISTINCT algorithm) AS algorithms FROM signals GROUP BY src, dst)
        SELECT * FROM s WHERE confidence >= CASE algorithms WHEN 1 THEN 0.6 WHEN 2 THEN 0.65 ELSE 0.6 END""",
    "edge_keep_best": f"WITH {SIGNALS}, r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY confidence DESC, evidence, type, algorithm, weight) AS rn FROM signals) SELECT src, dst, confidence, evidence FROM r WHERE rn = 1",
    "edge_keep_first": f"WITH {SIGNALS}, r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY evidence, confidence, type) AS rn FROM signals) SELECT src, dst, evidence, confidence FROM r WHERE rn = 1",
    "distinct_signals": f"WITH {SIGNALS} SELECT src, dst, algorithm, evidence, max(confidence) AS confidence FROM signals GROUP BY ALL",
    "evidence_summary": f"WITH {SIGNALS} SELECT src, dst, string_agg(DISTINCT algorithm, '+' ORDER BY algorithm) AS kinds, count(*) AS signals FROM signals GROUP BY src, dst",
    "review_manifest": f"WITH {SIGNALS}, p AS (SELECT src, dst, max(confidence) AS c FROM signals GROUP BY src, dst) SELECT CASE WHEN c > 0.85 THEN 'accepted' ELSE 'pending' END AS status, count(*) AS pairs FROM p GROUP BY 1",
    "bm25_topk": f"""WITH t AS (SELECT doc_id, {_tokens("coalesce(text, '')")} AS tokens FROM documents), one AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM t),
        q AS (SELECT unnest([{", ".join(f"'{x}'" for x in TERMS)}]) AS term), post AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS term FROM t),
        tf AS (SELECT doc_id, length, term, count(*) AS tf FROM post WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
        SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 3 / (tf + 2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS matched
        FROM tf JOIN df USING (term) JOIN q USING (term), one GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""",
    "suggest_names": f"""WITH {ENTITIES}, n AS (SELECT DISTINCT id AS name, lower(id) AS low FROM nodes), q AS (SELECT 'suplier 1' AS q),
        s AS (SELECT name, (CASE WHEN contains(low, q) OR contains(q, low) THEN 2 ELSE 0 END + CASE WHEN left(q, 3) = left(low, 3) THEN 1 ELSE 0 END
            + len(list_intersect(list_filter(string_split_regex(q, '[._/\\s-]+'), lambda t: length(t) >= 2 AND t NOT IN ('svc', 'app', 'the')), list_filter(string_split_regex(low, '[._/\\s-]+'), lambda t: length(t) >= 2 AND t NOT IN ('svc', 'app', 'the')))))::INTEGER AS score FROM n, q)
        SELECT name, score FROM s WHERE score > 0 ORDER BY score DESC, name LIMIT 5""",
    "search_snippets": f"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS flat FROM documents WHERE contains(lower(text), '{TERMS[3]}')), a AS (SELECT *, strpos(lower(flat), '{TERMS[3]}') AS place FROM d)
        SELECT doc_id, CASE WHEN place > 0 THEN substr(flat, greatest(place - 30, 1)::BIGINT, {60 + len(TERMS[3])}) ELSE left(flat, 60) END AS snippet FROM a""",
    "term_stats": f"WITH t AS (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM p GROUP BY term",
    "corpus_stats": f"""SELECT count(*) AS n, round(avg(len({_tokens("coalesce(text, '')")})), 4) AS mean_length FROM documents""",
    "tfidf_pairs": f"""WITH t AS (SELECT page_id AS doc_id, unnest({_tokens("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) AS term FROM pages), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        d AS (SELECT term, count(*) AS df FROM p GROUP BY term), w AS (SELECT doc_id, term, tf * ln(((SELECT count(*) FROM pages) - df + 0.5) / (df + 0.5) + 1) AS w FROM p JOIN d USING (term)),
        u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w)
        SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.w * b.w), 6) AS similarity FROM u a JOIN u b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 6) >= 0.35""",
    "document_chunks": f"""WITH {DOCS}, {LINES.format('docs')}, m AS (SELECT *, CASE WHEN starts_with(line, '## ') THEN 2 WHEN starts_with(line, '# ') THEN 1 ELSE 0 END AS level FROM lines),
        s AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM m)
        SELECT doc_id, section::BIGINT AS section, min(pos) + 1 AS start_line, max(pos) + 1 AS end_line, CASE section WHEN 0 THEN '' WHEN 1 THEN doc_id WHEN 2 THEN doc_id || ' > Dependencies' ELSE doc_id || ' > Notes' END AS heading_path,
            string_agg(line, chr(10) ORDER BY pos) AS content FROM s GROUP BY doc_id, section""",
    "section_tree": f"""WITH {DOCS}, {LINES.format('docs')}, m AS (SELECT *, CASE WHEN starts_with(line, '## ') THEN 2 WHEN starts_with(line, '# ') THEN 1 ELSE 0 END AS level FROM lines),
        s AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM m), n AS (SELECT doc_id, max(pos) AS last FROM lines GROUP BY doc_id),
        c AS (SELECT doc_id, section, min(pos) AS line_start, max(pos) AS line_end, max(level) AS level, coalesce(arg_min(left(trim(line), 200), pos) FILTER (level = 0 AND trim(line) <> ''), '') AS summary FROM s GROUP BY doc_id, section)
        SELECT doc_id, 0::BIGINT AS section, NULL::BIGINT AS parent, 0 AS level, '' AS heading, doc_id AS summary, 0::BIGINT AS line_start, last::BIGINT AS line_end FROM n
        UNION ALL SELECT doc_id, section::BIGINT, CASE WHEN section = 1 THEN 0 ELSE 1 END, level::INTEGER, CASE section WHEN 1 THEN doc_id WHEN 2 THEN 'Dependencies' ELSE 'Notes' END, summary, line_start::BIGINT, line_end::BIGINT FROM c""",
    "chunk_index_search": f"""WITH {EDITED}, one AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM chunks), post AS (SELECT chunk_id, doc_id, len(tokens) AS length, unnest(tokens) AS term FROM chunks),
        tf AS (SELECT chunk_id, doc_id, length, term, count(*) AS tf FROM post WHERE term IN ({", ".join(f"'{x}'" for x in INDEX_TERMS)}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
        SELECT chunk_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 3 / (tf + 2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS matched
        FROM tf JOIN df USING (term), one GROUP BY chunk_id, doc_id ORDER BY score DESC, chunk_id LIMIT 20""",
    "chunk_index_frequencies": f"WITH {EDITED}, p AS (SELECT DISTINCT chunk_id, unnest(tokens) AS term FROM chunks) SELECT term, count(*) AS df FROM p GROUP BY term",
    "line_windows": f"""WITH d AS (SELECT conv_id AS doc_id, max(text) AS text FROM conversations GROUP BY conv_id), {LINES.format('d')}
        SELECT doc_id, pos, array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS text,
            CASE WHEN pos / count(*) OVER (PARTITION BY doc_id) < 0.3 THEN 0.65::DOUBLE WHEN pos / count(*) OVER (PARTITION BY doc_id) < 0.6 THEN 0.55 ELSE 0.45 END AS weight FROM lines""",
    "line_windows_all": f"""WITH d AS (SELECT coalesce(conv_id::VARCHAR, '-') || '/' || coalesce(turn::VARCHAR, '-') || '/' || row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text) AS doc_id, text FROM conversations WHERE text IS NOT NULL), {LINES.format('d')}
        SELECT doc_id, pos, array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS text,
            CASE WHEN pos / count(*) OVER (PARTITION BY doc_id) < 0.3 THEN 0.65::DOUBLE WHEN pos / count(*) OVER (PARTITION BY doc_id) < 0.6 THEN 0.55 ELSE 0.45 END AS weight FROM lines""",
    "turn_windows": """WITH r AS (SELECT DISTINCT conv_id AS doc_id, turn AS pos, role AS line FROM conversations)
        SELECT doc_id, pos, array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS text FROM r""",
    "cooccurrence_window5": f"""WITH {LINES.format('documents')}, {HITS}, n AS (SELECT doc_id, count(*) AS total FROM lines GROUP BY doc_id),
        p AS (SELECT a.name AS src, b.name AS dst, a.doc_id, a.pos AS pa, b.pos AS pb, total, row_number() OVER (PARTITION BY a.name, b.name ORDER BY a.doc_id, a.pos, b.pos) AS rn
            FROM named a JOIN named b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.pos < a.pos + 5 AND a.name <> b.name AND (b.pos > a.pos OR a.name < b.name) JOIN n ON n.doc_id = a.doc_id)
        SELECT src, dst, CASE WHEN pa / total < 0.3 THEN 0.65::DOUBLE WHEN pa / total < 0.6 THEN 0.55 ELSE 0.45 END AS confidence, doc_id, pa AS pos FROM p WHERE rn = 1""",
    "lexicon_mentions": f"WITH {LINES.format('documents')}, {HITS} SELECT doc_id, name, max(CASE WHEN contains(lower(line), '`' || name || '`') THEN 0.9::DOUBLE ELSE 0.7 END) AS confidence, count(*) AS lines FROM named GROUP BY 1, 2",
    "structural_dependencies": f"WITH {PART_EDGES} SELECT e.src, e.dst, 0.8::DOUBLE AS confidence FROM edges e WHERE e.dst IN (SELECT src FROM edges)",
    "named_components": f"""WITH {NAMED}, every AS (
            SELECT 'ledger-' || d || '-service' AS id, 'Ledger ' || d || ' Service' AS name, 'service' AS type, path AS file FROM z WHERE m = 0 UNION ALL SELECT 'vault-' || d || '-database', 'Vault ' || d || ' Database', 'database', path FROM z WHERE m = 1
            UNION ALL SELECT 'gate-' || d || '-gateway', 'Gate ' || d || ' Gateway', 'api', path FROM z WHERE m = 3 UNION ALL SELECT 'token-' || d, 'token-' || d, 'unknown', path FROM z WHERE m = 2
            UNION ALL SELECT 'audit-' || d, 'Audit ' || d, 'unknown', path FROM z WHERE m = 2 UNION ALL SELECT 'relay-' || d || '-api', 'Relay ' || d || ' API', 'api', NULL FROM z WHERE m = 2
            UNION ALL SELECT 'ledger-' || {_near(-2)} || '-service', 'Ledger ' || {_near(-2)} || ' Service', 'service', NULL FROM z WHERE m = 2)
        SELECT id, min(name) AS name, min(type) AS type, min(file) AS file FROM every GROUP BY id""",
    "sentence_split": f"""WITH {NAMED} SELECT path, unnest(CASE m
            WHEN 0 THEN ['Ledger ' || d || ' depends on the Vault ' || {_near(1)} || ' database.', 'It was built in 2020.', 'The ledger calls gate ' || {_near(3)} || ' gateway!']
            WHEN 1 THEN ['Vault ' || d || ' uses Relay ' || {_near(1)} || ' API.', 'Vault ' || d || ' database connects to Ledger ' || {_near(-1)} || ' service.']
            WHEN 2 THEN ['Ledger ' || {_near(-2)} || ' Service - books', 'Relay ' || d || ' API: sends', 'Provides: token-' || d || ', Audit ' || d, 'Readers require token-' || d || '.', 'Gate ' || {_near(1)} || ' is forwarded to Ledger ' || {_near(-2)} || '.', 'Needs the vault ' || {_near(-1)} || ' database at night']
            ELSE ['Door ' || d || ' integrates with the old Ledger ' || {_near(-3)} || ' service today.'] END) AS sentence FROM z""",
    "entity_relations": f"""WITH {NAMED}, e AS (
            SELECT path AS src, k + 1 AS j, 'depends-on' AS type, 0.80::DOUBLE AS confidence FROM z WHERE m = 0 UNION ALL SELECT path, k + 3, 'calls', 0.75 FROM z WHERE m = 0
            UNION ALL SELECT path, k - 1, 'depends-on', 0.65 FROM z WHERE m = 1 UNION ALL SELECT path, k - 1, 'depends-on', 0.70 FROM z WHERE m = 2
            UNION ALL SELECT path, k - 3, 'calls', 0.75 FROM z WHERE m = 3)
        SELECT src, z.path AS dst, type, confidence FROM e JOIN z ON z.k = e.j""",
    "matched_components": f"""WITH {NAMED}, t AS (
            SELECT 'Ledger ' || d AS text, 'ledger-' || d || '-service' AS id, 'ending' AS stage FROM z WHERE m = 0 UNION SELECT 'Vault ' || {_near(1)} || ' database', 'vault-' || {_near(1)} || '-database', 'id' FROM z WHERE m = 0
            UNION SELECT 'gate ' || {_near(3)} || ' gateway', 'gate-' || {_near(3)} || '-gateway', 'id' FROM z WHERE m = 0
            UNION SELECT 'Vault ' || d, 'vault-' || d || '-database', 'alias' FROM z WHERE m = 1 UNION SELECT 'Relay ' || {_near(1)}, 'relay-' || {_near(1)} || '-api', 'ending' FROM z WHERE m = 1
            UNION SELECT 'Vault ' || d || ' database', 'vault-' || d || '-database', 'id' FROM z WHERE m = 1 UNION SELECT 'Ledger ' || {_near(-1)}, 'ledger-' || {_near(-1)} || '-service', 'ending' FROM z WHERE m = 1
            UNION SELECT 'token-' || d, 'token-' || d, 'id' FROM z WHERE m = 2 UNION SELECT 'Gate ' || {_near(1)}, 'gate-' || {_near(1)} || '-gateway', 'ending' FROM z WHERE m = 2
            UNION SELECT 'Ledger ' || {_near(-2)}, 'ledger-' || {_near(-2)} || '-service', 'ending' FROM z WHERE m = 2
            UNION SELECT 'Door ' || d, 'gate-' || d || '-gateway', 'alias' FROM z WHERE m = 3 UNION SELECT 'old Ledger ' || {_near(-3)} || ' service today', 'ledger-' || {_near(-3)} || '-service', 'inside' FROM z WHERE m = 3),
        known AS (SELECT 'ledger-' || d || '-service' AS id FROM z WHERE m = 0 UNION SELECT 'ledger-' || {_near(-2)} || '-service' FROM z WHERE m = 2 UNION SELECT 'vault-' || d || '-database' FROM z WHERE m = 1 UNION SELECT 'gate-' || d || '-gateway' FROM z WHERE m = 3
            UNION SELECT 'token-' || d FROM z WHERE m = 2 UNION SELECT 'relay-' || d || '-api' FROM z WHERE m = 2)
        SELECT text, id, stage FROM t JOIN known USING (id)""",
    "registry_components": f"""WITH {NAMED} SELECT regexp_extract(path, '([^/]+)[.]md$', 1) AS id, CASE m WHEN 0 THEN 'Ledger ' || d || ' Service' WHEN 1 THEN 'Vault ' || d || ' Database' WHEN 2 THEN 'overview-' || d ELSE 'Gate ' || d || ' Gateway {{#gate}}' END AS name,
        CASE m WHEN 0 THEN 'service' WHEN 1 THEN 'config-server' ELSE 'unknown' END AS type, path AS file FROM z""",
    "registry_relations": f"""WITH {PART_EDGES}, t AS (SELECT src, dst, n % 4 AS verb, dst IN (SELECT src FROM edges) AS known FROM edges),
        s AS (SELECT src, dst, 'link' AS kind, '' AS evidence, CASE WHEN known THEN 1.0::DOUBLE ELSE 0.5 END AS confidence FROM t
            UNION ALL SELECT src, dst, 'mention', CASE verb WHEN 0 THEN 'stated: depends-on' WHEN 1 THEN 'stated: calls' ELSE 'stated: mentions' END, CASE verb WHEN 0 THEN 0.8 WHEN 1 THEN 0.75 ELSE 0.7 END FROM t WHERE verb < 3
            UNION ALL SELECT src, dst, 'mention', 'listed', 0.8 FROM t WHERE known)
        SELECT src, dst, max(confidence) AS confidence, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS signals, arg_max(evidence, [confidence::VARCHAR, evidence]) FILTER (kind = 'mention') AS mention FROM s GROUP BY src, dst""",
    "verb_relations": f"""WITH {PART_EDGES}, t AS (SELECT src, dst, CASE n % 4 WHEN 0 THEN 'depends on' WHEN 1 THEN 'calls' WHEN 2 THEN 'uses' ELSE 'reads from' END AS verb FROM edges)
        SELECT src, dst, {VERB_SCORE} AS confidence, {VERB_TYPE} AS type, 1::BIGINT AS mentions FROM t WHERE verb <> 'reads from'""",
    "link_edges": f"WITH {PART_EDGES} SELECT 'docs/' || src || '.md' AS src, 'docs/' || dst || '.md' AS dst, 'references' AS type, CASE WHEN dst IN (SELECT src FROM edges) THEN 1.0::DOUBLE ELSE 0.5 END AS confidence FROM edges",
    "document_titles": f"""WITH {DOCS} SELECT doc_id, doc_id AS title, length(regexp_replace(regexp_replace(text, '(?m)^(?:#+ |- )', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')) AS plain_chars, 'docs' AS folder FROM docs""",
    "page_links": """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM h GROUP BY 1, 2""",
    "page_hosts": "SELECT regexp_extract(url, '^[a-z][a-z0-9+.-]*://(?:[^@/ ]*@)?([A-Za-z0-9._-]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1",
    "connection_strings": """WITH k AS (SELECT 'supplier-' || s_suppkey AS src, s_suppkey AS k FROM supplier UNION ALL SELECT 'customer-' || c_custkey, c_custkey FROM customer)
        SELECT src, CASE k % 5 WHEN 0 THEN 'db-' || k || '.internal' WHEN 1 THEN 'cache-' || k WHEN 2 THEN 'mysql-' || k WHEN 3 THEN 'pg-' || k ELSE 'queue-' || k END AS host,
            CASE k % 5 WHEN 0 THEN 'database' WHEN 1 THEN 'cache' WHEN 2 THEN 'database' WHEN 3 THEN 'database' ELSE 'unknown' END AS type FROM k""",
    "infrastructure_mentions": r"""WITH k AS (SELECT 'supplier-' || s_suppkey AS src, s_suppkey AS k FROM supplier UNION ALL SELECT 'customer-' || c_custkey, c_custkey FROM customer),
        v AS (SELECT src AS doc_id, CASE k % 5 WHEN 0 THEN 'postgres://app:pw@db-' || k || '.internal:5432/app' WHEN 1 THEN 'redis://cache-' || k || ':6379/0'
            WHEN 2 THEN 'user:pw@tcp(mysql-' || k || ':3306)/app' WHEN 3 THEN 'host=pg-' || k || ' port=5432 dbname=app' ELSE 'queue-' || k || ':9092' END AS text FROM k
            UNION ALL SELECT 'page-' || page_id, html FROM pages),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM v),
        p(name, type, confidence, pattern) AS (VALUES ('dynamodb', 'database', 0.85::DOUBLE, 'dynamodb'), ('postgresql', 'database', 0.85, 'postgresql|postgres'), ('mysql', 'database', 0.85, 'mysql'),
            ('mongodb', 'database', 0.85, 'mongodb|mongo'), ('redis', 'cache', 0.85, 'redis'), ('cassandra', 'database', 0.85, 'cassandra'), ('aurora', 'database', 0.85, 'aurora|aws aurora'), ('rds', 'database', 0.80, 'rds|aws rds|amazon rds'),
            ('s3', 'storage', 0.85, 's3|aws s3|amazon s3'), ('aws-secrets-manager', 'secrets-manager', 0.85, 'secrets manager|aws secrets manager|secretsmanager'), ('kms', 'secrets-manager', 0.80, 'kms|aws kms|key management service'),
            ('cloudformation', 'config-server', 0.85, 'cloudformation|aws cloudformation'), ('sns', 'queue', 0.80, 'sns|aws sns'), ('sqs', 'queue', 0.80, 'sqs|aws sqs'), ('kinesis', 'queue', 0.85, 'kinesis|aws kinesis'),
            ('lambda', 'service', 0.85, 'lambda|aws lambda'), ('ecr', 'container-registry', 0.80, 'ecr|aws ecr'), ('eks', 'orchestrator', 0.80, 'eks|aws eks'), ('iam', 'service', 0.75, 'iam|aws iam'), ('ldap', 'service', 0.85, 'ldap'),
            ('active-directory', 'service', 0.80, 'active directory|activedirectory'), ('okta', 'service', 0.85, 'okta'), ('oauth', 'service', 0.75, 'oauth'), ('kafka', 'message-broker', 0.85, 'kafka|apache kafka'),
            ('rabbitmq', 'message-broker', 0.85, 'rabbitmq'), ('nats', 'message-broker', 0.85, 'nats'), ('eventbridge', 'message-broker', 0.85, 'eventbridge'), ('prometheus', 'monitoring', 0.85, 'prometheus'), ('datadog', 'monitoring', 0.85, 'datadog'),
            ('grafana', 'monitoring', 0.85, 'grafana'), ('pagerduty', 'monitoring', 0.85, 'pagerduty|pager duty'), ('new-relic', 'monitoring', 0.85, 'new relic|newrelic'), ('vault', 'secrets-manager', 0.85, 'vault|hashicorp vault'),
            ('haproxy', 'load-balancer', 0.85, 'haproxy'), ('nginx', 'load-balancer', 0.85, 'nginx'), ('envoy', 'load-balancer', 0.85, 'envoy'), ('alb', 'load-balancer', 0.80, 'alb|application load balancer'),
            ('elasticsearch', 'search', 0.85, 'elasticsearch'), ('opensearch', 'search', 0.85, 'opensearch'), ('kubernetes', 'orchestrator', 0.85, 'kubernetes|k8s'), ('docker', 'orchestrator', 0.75, 'docker'),
            ('consul', 'config-server', 0.85, 'consul'), ('etcd', 'config-server', 0.85, 'etcd')),
        h AS (SELECT doc_id, name, type, confidence, pos, line, row_number() OVER (PARTITION BY doc_id, name ORDER BY pos) AS turn FROM l JOIN p ON length(trim(line)) >= 3 AND regexp_matches(line, '(?i)\b(?:' || pattern || ')\b')
            AND (name <> 'iam' OR regexp_matches(lower(line), 'use|connect|store|access|authenticate|deploy|manage')))
        SELECT doc_id, name, type, confidence, pos::INTEGER AS line, trim(CASE WHEN length(line) > 100 THEN line[1:100] || '...' ELSE line END) AS evidence FROM h WHERE turn = 1""",
    "name_aliases": r"""WITH n AS (SELECT DISTINCT p_name || ' Service' AS name FROM part), k AS (SELECT name, regexp_replace(lower(trim(name)), '[\s_]+', '-', 'g') AS kebab FROM n),
        a AS (SELECT name, unnest([name, kebab, regexp_replace(kebab, '-(?:service|api|server|svc|db|component)$', '')]) AS alias FROM k) SELECT DISTINCT name, alias FROM a""",
    "component_types": f"""WITH k(n, o, k, type) AS (VALUES {KEYS}), names AS (SELECT p_partkey, lower(p_type) || CASE p_partkey % 6 WHEN 0 THEN ' api' WHEN 1 THEN ' redis cache' WHEN 2 THEN ' worker' WHEN 3 THEN ' db' WHEN 4 THEN ' queue' ELSE ' gateway' END AS name FROM part),
        h AS (SELECT p_partkey, n, o, type, first_value(type) OVER (PARTITION BY p_partkey ORDER BY n DESC, o) AS best FROM names JOIN k ON contains(name, k))
        SELECT p.p_partkey, coalesce(max(best), 'unknown') AS type, CASE WHEN max(best) IS NULL THEN 0.5::DOUBLE ELSE round(least(0.95, 0.85 + 0.05 * (count(*) FILTER (h.type = best) - 1)), 4) END AS confidence
        FROM part p LEFT JOIN h ON h.p_partkey = p.p_partkey GROUP BY p.p_partkey""",
    "detected_components": f"""WITH {ENTITIES}, {DEGREES}, s AS (SELECT n.id, CASE WHEN regexp_matches(lower(n.id), 'component|service') THEN 0.9::DOUBLE WHEN regexp_matches(lower(title), 'component|service') THEN 0.7 WHEN incoming_edges >= 3 THEN 0.4 END AS confidence FROM nodes n LEFT JOIN degrees d ON d.id = n.id)
        SELECT id, confidence FROM s WHERE confidence IS NOT NULL""",
    "longest_prefix_components": """WITH en AS (SELECT DISTINCT source FROM documents WHERE lang = 'en')
        SELECT 'src/' || source || '/' || lang || '/' || doc_id || '.md' AS file, CASE WHEN lang = 'en' THEN source || '-en' ELSE source END AS component FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""",
    "vector_topk": """WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = 0)
        SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), v), 6) AS similarity FROM embeddings, q WHERE vec_id <> 0 ORDER BY similarity DESC, vec_id LIMIT 10""",
    "vector_topk_all": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % 100 = 0),
        s AS (SELECT query_id, vec_id, round(list_cosine_similarity(v, q), 6) AS similarity FROM e JOIN q ON vec_id <> query_id)
        SELECT query_id, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 10""",
    "vector_centroids": "WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, place, round(avg(x), 6) AS value FROM e GROUP BY 1, 2",
    "change_detection": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM documents
        WHERE (doc_id % 5 = 0 AND doc_id % 11 <> 0) OR (doc_id % 5 <> 0 AND doc_id % 11 = 0) OR (doc_id % 5 <> 0 AND doc_id % 11 <> 0 AND doc_id % 7 = 0)""",
    "document_upsert": "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN upper(lang) ELSE lang END AS lang FROM documents WHERE doc_id % 4 = 1 OR doc_id % 3 <> 0",
    "provenance_errors": """WITH r AS (SELECT CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '/docs/' || l_orderkey ELSE 'docs/' || l_orderkey END AS file,
            CASE l_returnflag WHEN 'A' THEN 'structural' WHEN 'R' THEN 'guess' ELSE '' END AS method, CASE l_linestatus WHEN 'O' THEN 'line ' || l_linenumber ELSE '' END AS noted, l_linenumber - 2 AS t FROM lineitem)
        SELECT CASE WHEN file = '' AND method = '' AND noted = '' AND t = 0 THEN NULL WHEN file = '' OR file[1:1] = '/' THEN 'source_file' WHEN method = 'guess' THEN 'extraction_method'
            WHEN noted = '' THEN 'evidence' WHEN t <= 0 THEN 'last_modified' END AS error, file <> '' AND file[1:1] <> '/' AND t >= 0 AS located, count(*) AS n FROM r GROUP BY 1, 2""",
    "unstated_edges": f"""WITH {SIGNALS} SELECT src, dst, type, max(confidence) AS confidence FROM signals s
        WHERE NOT EXISTS (SELECT 1 FROM signals c WHERE c.algorithm = 'code' AND c.src = s.src AND c.dst = s.dst AND c.type = s.type) GROUP BY 1, 2, 3""",
    "target_types": """SELECT 'part-' || l_partkey AS dst, coalesce(arg_min(CASE l_returnflag WHEN 'A' THEN 'database' ELSE 'service' END, (l_orderkey::BIGINT * 1000 + l_linenumber)) FILTER (l_returnflag <> 'R'), 'unknown') AS component_type
        FROM lineitem GROUP BY l_partkey""",
    "boosted_hints": f"""WITH {SIGNALS}, r AS (SELECT * FROM signals WHERE algorithm = 'cooccurrence' OR confidence > 0.85), k AS (SELECT DISTINCT dst FROM r WHERE algorithm <> 'cooccurrence')
        SELECT src, dst, CASE algorithm WHEN 'cooccurrence' THEN 'comment_hint' ELSE algorithm END AS signal_type,
            max(CASE WHEN algorithm = 'cooccurrence' AND dst IN (SELECT dst FROM k) THEN 0.5::DOUBLE ELSE confidence END) AS confidence, count(*) AS n FROM r GROUP BY 1, 2, 3""",
    "registry_merged": f"""WITH {PART_EDGES} SELECT src, dst, CASE WHEN n > 1 THEN 'depends-on' ELSE 'mentions' END AS type,
            CASE WHEN n > 1 THEN greatest(confidence, round(1 - confidence * 0.4, 6)) ELSE round(1 - confidence * 0.4, 6) END AS confidence FROM edges""",
    "nodes_with_stubs": f"""WITH {ENTITIES} SELECT id, title, component_type FROM nodes WHERE id NOT LIKE 'nation-%'
        UNION ALL SELECT DISTINCT dst, dst, CASE WHEN dst LIKE 'nation-%1' THEN 'gateway' ELSE 'unknown' END FROM edges""",
    "merged_components": f"""WITH {SIGNALS}, b AS (SELECT dst AS id, evidence AS file, confidence, algorithm AS origin, row_number() OVER (PARTITION BY dst ORDER BY algorithm, confidence DESC, evidence) AS turn
            FROM signals WHERE algorithm IN ('code', 'structural')) SELECT id, file, confidence, origin FROM b WHERE turn = 1""",
    "environment_references": f"WITH {FILES} SELECT path, target AS name FROM found WHERE kind = 'env_var_ref' AND path NOT LIKE '%.tfvars'",
    "endpoint_pairs": f"WITH {KEYS_OF} SELECT src || CASE k % 8 WHEN 0 THEN '/app.py' WHEN 1 THEN '/main.go' ELSE '/index.ts' END AS path, 'GET /v1/items/' || k AS endpoint FROM k WHERE k % 8 < 3",
    "code_signals": f"""WITH {FILES}, text AS ({SOURCE_LINES})
        SELECT path AS file_path, f.line::BIGINT AS line_number, target AS target_component, type AS target_type, kind AS signal_type, language, confidence, CASE WHEN path LIKE '%go.mod' THEN regexp_extract(replace(said, '{{k}}', k::VARCHAR), '[^ \t]+ v[0-9][^ ]*') ELSE trim(replace(said, '{{k}}', k::VARCHAR), ' ' || chr(9)) END AS evidence
        FROM found f JOIN text t ON t.m = f.k % 8 AND t.file = split_part(f.path, '/', 2) AND t.line = f.line""",
    "code_graph": f"WITH {FILES} SELECT src, target AS dst, max(confidence) AS confidence, count(*) AS evidence FROM found WHERE length(target) >= 3 AND target <> 'the' GROUP BY src, target",
    "code_signal_kinds": f"WITH {FILES} SELECT language, kind AS signal_type, count(*) AS n FROM found GROUP BY 1, 2",
    "comment_hints": f"""WITH {FILES} SELECT src AS source_component, path AS file_path, line::BIGINT AS line_number, target AS target_component, type AS target_type,
        CASE WHEN confidence = 0.4 AND regexp_matches(target, '^(audit|grid|nowhere)-') AND k IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) THEN 0.5 ELSE confidence END AS confidence FROM found WHERE kind = 'comment_hint'""",
    "terraform_cross_reference": f"""WITH {KEYS_OF} SELECT src AS source_component, unnest(['sessions-' || k, 'orders-db']) AS src, unnest(['aws_elasticache_replication_group.sessions', 'aws_db_instance.orders_' || k]) AS dst, unnest([0.8::DOUBLE, 0.7]) AS confidence FROM k WHERE k % 8 = 6
        UNION ALL SELECT src, unnest(['broker-' || k, 'lambda-worker-node']), unnest(['aws_msk_cluster.stream', 'aws_lambda_function.report']), unnest([0.6::DOUBLE, 0.55]) FROM k WHERE k % 8 = 7""",
    "streamed_event_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "streamed_edges": f"WITH {SIGNALS} SELECT src, dst, max(confidence) AS confidence, count(*) AS signals FROM signals GROUP BY src, dst",
}
