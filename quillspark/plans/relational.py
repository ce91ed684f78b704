"""Queries over retrieval, analytics, tenancy, usage and billing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.vector import similarity_from_distance
from quillspark.operators import analytics, billing, ingest, plans, retrieval, tenancy, usage
from quillspark.plans.views import table, view, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Ten hours of the test conversations lie before the window of thirty days.
NOW = 1704067200000 + 30 * 86_400_000 + 10 * 3_600_000
FLOOR = 0.15


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


def v(s: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [view(s, d, n) for n in names]


NEAR = """
WITH p AS (
  SELECT q.workspace_id, q.chunk_id AS query_id, c.chunk_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS distance
  FROM v_vectors q JOIN v_vectors c ON q.workspace_id = c.workspace_id),
t AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, query_id ORDER BY distance, chunk_id) AS rank FROM p QUALIFY rank <= 10)
"""
SIM = "greatest(-1.0, least(1.0, 1 - distance * distance / 2))"


def _hits(s: SparkSession, d: str) -> DataFrame:
    vectors = view(s, d, "vectors")
    return retrieval.knn_batch(vectors, vectors.select("workspace_id", F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query")))


@query(f"""
WITH q AS (SELECT workspace_id, embedding FROM v_vectors ORDER BY chunk_id LIMIT 1),
n AS (SELECT c.chunk_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS distance
      FROM v_vectors c JOIN q ON q.workspace_id = c.workspace_id ORDER BY distance, chunk_id LIMIT 10)
SELECT chunk_id, round(distance, 6) AS distance, round({SIM}, 6) AS similarity, {SIM} >= {FLOOR} AS kept FROM n""")
def knn_topk(s, d):
    vectors = view(s, d, "vectors")
    asked = vectors.orderBy("chunk_id").limit(1).first()
    near = retrieval.knn(vectors, asked["workspace_id"], asked["embedding"], 10)
    similarity = similarity_from_distance(F.col("distance"))
    return near.select("chunk_id", F.round("distance", 6).alias("distance"), F.round(similarity, 6).alias("similarity"), (similarity >= FLOOR).alias("kept"))


@query(f"{NEAR} SELECT workspace_id, query_id, chunk_id, rank, round(distance, 6) AS distance FROM t")
def knn_batch_topk(s, d):
    return _hits(s, d).withColumn("distance", F.round("distance", 6))


@query(f"""{NEAR} SELECT workspace_id, query_id, CASE WHEN max({SIM}) >= {FLOOR} THEN 'answered' ELSE 'refused' END AS outcome, round(max({SIM}), 6) AS top_similarity,
  least(5, count(*) FILTER (WHERE {SIM} >= {FLOOR})) AS passages FROM t GROUP BY workspace_id, query_id""")
def decide_outcomes(s, d):
    return retrieval.decide(_hits(s, d), FLOOR).withColumns({"top_similarity": F.round("top_similarity", 6), "passages": F.size("passages").cast("long")})


CHUNKS = "SELECT page_id AS chunk_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 40 END AS source_id FROM pages"


@query(f"""{NEAR}, c AS ({CHUNKS}), s AS (SELECT page_id AS source_id, 'title ' || page_id AS title, url FROM pages WHERE page_id < 30)
SELECT t.query_id, t.rank, t.chunk_id, coalesce(s.title, '') AS title, coalesce(s.url, '') AS url FROM t JOIN c ON t.chunk_id = c.chunk_id LEFT JOIN s ON c.source_id = s.source_id""")
def citations_join(s, d):
    pages = table(s, d, "pages")
    chunks = pages.select(F.col("page_id").alias("chunk_id"), F.when(F.col("page_id") % 3 != 0, F.col("page_id") % 40).alias("source_id"))
    sources = pages.where("page_id < 30").select(F.col("page_id").alias("source_id"), F.concat(F.lit("title "), F.col("page_id").cast("string")).alias("title"), "url")
    return retrieval.cite(_hits(s, d), chunks, sources).select("query_id", "rank", "chunk_id", "title", "url")


@query("SELECT chunk_id, workspace_id FROM v_vectors WHERE chunk_id NOT IN (SELECT page_id FROM pages)")
def orphan_sweep(s, d):
    return retrieval.orphans(view(s, d, "vectors"), table(s, d, "pages").select(F.col("page_id").alias("chunk_id"))).select("chunk_id", "workspace_id")


@query("SELECT workspace_id, count(*) AS vectors FROM v_vectors WHERE chunk_id IN (SELECT page_id FROM pages) GROUP BY 1")
def vectors_swept(s, d):
    return retrieval.sweep(view(s, d, "vectors"), table(s, d, "pages").select(F.col("page_id").alias("chunk_id"))).groupBy("workspace_id").agg(F.count("*").alias("vectors"))


@query("SELECT workspace, count(*) AS conversations, count(*) FILTER (WHERE status = 'auto_resolved') AS auto_resolved, count(*) FILTER (WHERE status = 'escalated') AS escalated, count(*) FILTER (WHERE status = 'human') AS human FROM v_conversations GROUP BY 1")
def conv_status_counts(s, d):
    return analytics.status_counts(view(s, d, "conversations"))


@query("SELECT workspace, resolution_signal, count(*) AS n FROM v_conversations WHERE status = 'auto_resolved' AND resolution_signal <> '' GROUP BY 1, 2")
def resolution_breakdown(s, d):
    return analytics.resolutions(view(s, d, "conversations"))


@query("SELECT workspace, language, count(*) AS n FROM v_conversations WHERE language <> '' GROUP BY 1, 2")
def language_counts(s, d):
    return analytics.languages(view(s, d, "conversations"))


@query("SELECT workspace, count(*) FILTER (WHERE outcome = 'answered') AS answered, count(*) FILTER (WHERE outcome = 'refused') AS unanswered FROM v_messages GROUP BY 1")
def outcome_counts(s, d):
    return analytics.outcomes(view(s, d, "messages"))


@query("SELECT workspace, count(*) FILTER (WHERE rating = 'up') AS up, count(*) FILTER (WHERE rating = 'down') AS down FROM v_messages GROUP BY 1")
def rating_counts(s, d):
    return analytics.ratings(view(s, d, "messages"))


@query(f"SELECT workspace, count(*) AS leads FROM v_leads WHERE created_ms >= {NOW - 30 * 86_400_000} GROUP BY 1")
def leads_count(s, d):
    return analytics.scoped(view(s, d, "leads"), None, NOW).groupBy("workspace").agg(F.count("*").alias("leads"))


@query("SELECT workspace, count(*) AS open_gaps FROM v_questions WHERE NOT answered GROUP BY 1")
def open_gaps(s, d):
    return view(s, d, "questions").where("not answered").groupBy("workspace").agg(F.count("*").alias("open_gaps"))


PAIRS = "SELECT workspace, conversation, min(created_ms) FILTER (WHERE role = 'user') AS first_user_ms, min(created_ms) FILTER (WHERE role IN ('assistant', 'human')) AS first_reply_ms FROM v_messages GROUP BY 1, 2"


@query(PAIRS)
def first_response_pairs(s, d):
    return analytics.first_responses(view(s, d, "messages"))


@query(f"WITH p AS ({PAIRS}) SELECT workspace, CAST(floor(quantile_cont(CASE WHEN first_reply_ms > first_user_ms THEN first_reply_ms - first_user_ms END, 0.5)) AS BIGINT) AS median_ms FROM p GROUP BY 1")
def first_response_median(s, d):
    return analytics.median_response(analytics.first_responses(view(s, d, "messages")))


SINCE = f"created_ms >= {NOW - 30 * 86_400_000}"


@query(f"""
WITH c AS (SELECT * FROM v_conversations WHERE {SINCE}), m AS (SELECT * FROM v_messages WHERE {SINCE}),
w AS (SELECT workspace FROM c UNION SELECT workspace FROM m UNION SELECT workspace FROM v_leads WHERE {SINCE} UNION SELECT workspace FROM v_questions WHERE NOT answered),
p AS ({PAIRS.replace('v_messages', 'm')})
SELECT w.workspace,
  (SELECT count(*) FROM c WHERE c.workspace = w.workspace) AS conversations,
  (SELECT count(*) FROM c WHERE c.workspace = w.workspace AND status = 'auto_resolved') AS auto_resolved,
  (SELECT count(*) FROM m WHERE m.workspace = w.workspace AND outcome = 'answered') AS answered,
  (SELECT count(*) FROM m WHERE m.workspace = w.workspace AND outcome = 'refused') AS unanswered,
  (SELECT count(*) FROM m WHERE m.workspace = w.workspace AND rating = 'up') AS up,
  (SELECT count(*) FROM v_leads l WHERE l.workspace = w.workspace AND {SINCE}) AS leads,
  (SELECT count(*) FROM v_questions q WHERE q.workspace = w.workspace AND NOT answered) AS open_gaps,
  (SELECT count(*) FROM c WHERE c.workspace = w.workspace AND language = 'ar') AS arabic,
  (SELECT CAST(floor(quantile_cont(first_reply_ms - first_user_ms, 0.5)) AS BIGINT) FROM p WHERE p.workspace = w.workspace AND first_reply_ms > first_user_ms) AS median_ms
FROM w""")
def analytics_summary(s, d):
    c, m, leads, gaps = v(s, d, "conversations", "messages", "leads", "questions")
    whole = analytics.summary(c, m, leads, gaps, None, NOW)
    arabic = F.coalesce(F.col("language_map")["ar"], F.lit(0).cast("long")).alias("arabic")
    return whole.select("workspace", "conversations", "auto_resolved", "answered", "unanswered", "up", "leads", "open_gaps", arabic, "median_ms")


@query("""
WITH m AS (SELECT workspace, role FROM v_memberships WHERE usr = 7), s AS (SELECT s_nationkey AS workspace, count(*) AS sources FROM supplier GROUP BY 1),
c AS (SELECT c_nationkey AS workspace, count(*) AS customers FROM customer GROUP BY 1)
SELECT w.workspace, w.account, w.name, coalesce(m.role, '') AS role, coalesce(s.sources, 0) AS sources, coalesce(c.customers, 0) AS customers
FROM v_workspaces w LEFT JOIN m ON w.workspace = m.workspace LEFT JOIN s ON w.workspace = s.workspace LEFT JOIN c ON w.workspace = c.workspace""")
def workspace_overview(s, d):
    sources = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("workspace")).agg(F.count("*").alias("sources"))
    customers = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("workspace")).agg(F.count("*").alias("customers"))
    return tenancy.overview(view(s, d, "workspaces"), view(s, d, "memberships"), 7, sources, customers).select("workspace", "account", "name", "role", "sources", "customers")


OWNED = "SELECT m.usr, w.account FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY created_ms, workspace) AS n FROM v_memberships WHERE role = 'owner') m JOIN v_workspaces w ON m.workspace = w.workspace WHERE n = 1"


@query(f"""WITH o AS ({OWNED}) SELECT m.usr, m.workspace, m.role, w.account, coalesce(a.account_name, '') AS account_name
FROM v_memberships m JOIN v_workspaces w ON m.workspace = w.workspace LEFT JOIN v_accounts a ON w.account = a.account LEFT JOIN o ON m.usr = o.usr WHERE w.account IS DISTINCT FROM o.account""")
def shared_workspaces(s, d):
    return tenancy.shared_workspaces(*v(s, d, "memberships", "workspaces", "accounts")).withColumnRenamed("user", "usr")


@query(OWNED)
def owned_accounts(s, d):
    return tenancy.owned_accounts(*v(s, d, "memberships", "workspaces")).withColumnRenamed("user", "usr")


@query("SELECT workspace, account, name FROM v_workspaces WHERE workspace IN (SELECT workspace FROM v_memberships WHERE usr = 7)")
def tenant_semi_join(s, d):
    return tenancy.visible(view(s, d, "workspaces"), view(s, d, "memberships"), 7).select("workspace", "account", "name")


@query("SELECT workspace, account, name FROM v_workspaces WHERE workspace IN (SELECT workspace FROM v_memberships WHERE usr = 7 AND role IN ('owner', 'admin'))")
def manager_rule(s, d):
    return tenancy.manageable(view(s, d, "workspaces"), view(s, d, "memberships"), 7).select("workspace", "account", "name")


@query("SELECT DISTINCT w.account, m.usr FROM v_memberships m JOIN v_workspaces w ON m.workspace = w.workspace")
def account_members(s, d):
    return tenancy.account_members(*v(s, d, "memberships", "workspaces")).withColumnRenamed("user", "usr")


@query("""
WITH m AS (SELECT DISTINCT w.account, m.usr, u.email FROM v_memberships m JOIN v_workspaces w ON m.workspace = w.workspace JOIN v_users u ON m.usr = u.usr),
i AS (SELECT DISTINCT w.account, lower(i.email) AS email FROM v_invitations i JOIN v_workspaces w ON i.workspace = w.workspace WHERE i.expires_ms > 30000),
p AS (SELECT i.account, count(*) AS n FROM i WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.account = i.account AND m.email = i.email) GROUP BY 1),
k AS (SELECT account, count(*) AS n FROM m GROUP BY 1)
SELECT coalesce(k.account, p.account) AS account, coalesce(k.n, 0) AS members, coalesce(p.n, 0) AS pending, coalesce(k.n, 0) + coalesce(p.n, 0) AS seats FROM k FULL JOIN p ON k.account = p.account""")
def seat_usage(s, d):
    m, w, u, i = v(s, d, "memberships", "workspaces", "users", "invitations")
    return tenancy.seats(m, w, u, i, 30000)


@query("SELECT usr, workspace, role, created_ms FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY role DESC, created_ms, workspace) AS n FROM v_memberships) WHERE n = 1")
def preferred_membership(s, d):
    return tenancy.preferred_memberships(view(s, d, "memberships")).withColumnRenamed("user", "usr").select("usr", "workspace", "role", "created_ms")


@query("""WITH e AS (SELECT event_id, event_id % 25 AS workspace, user_id % 97 AS actor, CASE WHEN event_id % 10 = 0 THEN user_id % 97 ELSE event_id % 97 END AS target FROM events),
r AS (SELECT e.event_id, e.actor = e.target AS himself, coalesce(a.role, '') AS actor, coalesce(t.role, '') AS target FROM e LEFT JOIN v_memberships a ON a.workspace = e.workspace AND a.usr = e.actor LEFT JOIN v_memberships t ON t.workspace = e.workspace AND t.usr = e.target)
SELECT event_id, actor, target, (actor = 'owner' AND target IN ('admin', 'agent')) OR (actor = 'admin' AND target = 'agent') AS assign,
  target <> 'owner' AND (himself OR actor = 'owner' OR (actor = 'admin' AND target = 'agent')) AS remove FROM r""")
def role_matrix(s, d):
    """Events read as one member acting on another of the same workspace, or on himself."""
    e = table(s, d, "events").select("event_id", (F.col("event_id") % 25).alias("workspace"), (F.col("user_id") % 97).alias("who"), F.when(F.col("event_id") % 10 == 0, F.col("user_id") % 97).otherwise(F.col("event_id") % 97).alias("whom"))
    roles = view(s, d, "memberships")
    named = lambda user, role: roles.select("workspace", F.col("user").alias(user), F.col("role").alias(role))
    rows = e.join(named("who", "actor"), ["workspace", "who"], "left").join(named("whom", "target"), ["workspace", "whom"], "left").fillna("", ["actor", "target"])
    actor, target = F.col("actor"), F.col("target")
    return rows.select("event_id", actor, target, tenancy.can_assign(actor, target).alias("assign"), tenancy.can_remove(actor, target, F.col("who") == F.col("whom")).alias("remove"))


@query("SELECT workspace, lower(trim(email)) AS email, expires_ms FROM (SELECT *, row_number() OVER (PARTITION BY workspace, lower(email) ORDER BY created_ms DESC) AS n FROM v_invitations) WHERE n = 1")
def invitations_latest(s, d):
    return tenancy.latest_invitations(view(s, d, "invitations")).select("workspace", "email", "expires_ms")


@query("SELECT account, strftime(ts, '%Y-%m') AS period, count(*) AS replies, round(count(*) FILTER (WHERE overage) * 0.02, 6) AS overage_usd FROM v_replies GROUP BY 1, 2")
def usage_monthly(s, d):
    return usage.monthly_usage(view(s, d, "replies")).withColumn("overage_usd", F.round("overage_usd", 6))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 60 < 50 THEN 'allow' WHEN o_custkey % 4 <= 0 THEN 'deny' WHEN (o_orderkey % 10) / 10.0::DOUBLE + 0.02::DOUBLE > (o_custkey % 4)::DOUBLE / 4 THEN 'deny' ELSE 'overage' END AS verdict FROM orders""")
def usage_verdict(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", usage.verdict(F.col("o_orderkey") % 60, F.lit(50), (F.col("o_orderkey") % 10) / F.lit(10.0), (F.col("o_custkey") % 4).cast("double") / 4).alias("verdict"))


@query("""
WITH a AS (SELECT account, strftime(ts, '%Y-%m') AS period, seq, account % 3 AS lim, (account % 5) * 0.02::DOUBLE AS cap FROM v_metered),
n AS (SELECT *, row_number() OVER w AS n FROM a WINDOW w AS (PARTITION BY account, period ORDER BY seq)),
r AS (SELECT *, coalesce(sum(CASE WHEN n > lim THEN 0.02::DOUBLE ELSE 0 END) OVER (PARTITION BY account, period ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM n)
SELECT account, period, seq, n, CASE WHEN n - 1 < lim THEN 'allow' WHEN cap <= 0 THEN 'deny' WHEN spent + 0.02::DOUBLE > cap THEN 'deny' ELSE 'overage' END AS verdict FROM r""")
def overage_running(s, d):
    rows = view(s, d, "metered").withColumns({"period": usage.period(F.col("ts")), "limit": F.col("account") % 3, "cap": (F.col("account") % 5) * F.lit(0.02)})
    return usage.running_overage(rows, "seq").select("account", "period", "seq", F.col("n").cast("long").alias("n"), "verdict")


GAPS = r"SELECT workspace, trim(regexp_replace(question, '\s+', ' ', 'g')) AS question_normalized, count(*) AS n, max(similarity)::DOUBLE AS best_similarity, arg_min(question, seq) AS question, arg_min(language, seq) AS language FROM v_questions GROUP BY 1, 2"


def _gaps(s, d):
    return usage.gap_fold(view(s, d, "questions"), "seq").withColumn("best_similarity", F.col("best_similarity").cast("double"))


@query(GAPS)
def gap_fold(s, d):
    return _gaps(s, d)


@query(f"WITH g AS ({GAPS}) SELECT workspace, question_normalized, n FROM g WHERE best_similarity >= 0.25")
def near_miss_gaps(s, d):
    return usage.near_misses(_gaps(s, d)).select("workspace", "question_normalized", "n")


@query(f"WITH g AS ({GAPS}) SELECT workspace, question_normalized, n, row_number() OVER (PARTITION BY workspace ORDER BY n DESC, question_normalized) AS place FROM g QUALIFY place <= 5")
def top_gaps(s, d):
    ranked = _gaps(s, d).withColumn("place", F.expr("row_number() OVER (PARTITION BY workspace ORDER BY n DESC, question_normalized)"))
    return ranked.where("place <= 5").select("workspace", "question_normalized", "n", F.col("place").cast("long").alias("place"))


@query("SELECT conversation, max(lead) AS lead, count(*) AS requests, count(*) > 1 AS already_open, 'pending' AS status FROM v_leads GROUP BY 1")
def escalation_fold(s, d):
    return usage.escalation_fold(view(s, d, "leads").withColumn("seq", F.col("lead")))


@query("SELECT event_id, min(seq) AS seq, arg_min(type, seq) AS type FROM v_ledger_events GROUP BY 1")
def event_dedup(s, d):
    return billing.ledger(view(s, d, "ledger_events")).select("event_id", "seq", "type")


@query("SELECT conversation, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY created_ms DESC, turn DESC) AS back FROM v_messages) WHERE back <= 6")
def last_n_turns(s, d):
    return analytics.last_turns(view(s, d, "messages"), 6).select("conversation", "turn", "role")


@query("SELECT conversation, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY created_ms DESC, turn DESC) AS back FROM v_messages) WHERE back <= 50")
def history_50(s, d):
    return analytics.last_turns(view(s, d, "messages"), 50).select("conversation", "turn", "role")


@query("SELECT conversation, status, created_ms FROM v_conversations ORDER BY status NOT IN ('escalated', 'human'), created_ms DESC, conversation")
def inbox_order(s, d):
    return analytics.inbox(view(s, d, "conversations")).select("conversation", "status", "created_ms")


PLAN = "CASE c_custkey % 6 WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'growth' WHEN 3 THEN 'pro' WHEN 4 THEN 'agency' ELSE 'gold' END"


def _planned(s, d):
    return table(s, d, "customer").select("c_custkey", F.expr(PLAN).alias("plan"))


@query(f"""WITH l(plan, replies, chunks) AS (VALUES ('free', 50, 500), ('starter', 1000, 10000), ('growth', 4000, 50000), ('pro', 10000, 200000), ('agency', 25000, 200000)),
c AS (SELECT c_custkey, {PLAN} AS plan FROM customer)
SELECT c.c_custkey, c.plan, coalesce(l.replies, 50)::BIGINT AS replies, coalesce(l.chunks, 500)::BIGINT AS chunks FROM c LEFT JOIN l ON c.plan = l.plan""")
def plan_limits(s, d):
    return plans.with_limits(_planned(s, d)).select("c_custkey", "plan", "replies", "chunks")


@query(f"WITH c AS (SELECT c_custkey, {PLAN} AS plan FROM customer) SELECT c_custkey, plan FROM c WHERE plan IN ('growth', 'pro', 'agency')")
def feature_gate(s, d):
    return plans.having(_planned(s, d), "knowledgeGaps").select("c_custkey", "plan")


@query(f"WITH c AS (SELECT c_custkey, {PLAN} AS plan FROM customer) SELECT c_custkey FROM c WHERE plan IN ('starter', 'growth', 'pro', 'agency')")
def handoff_gate(s, d):
    return plans.handoff_enabled(_planned(s, d)).select("c_custkey")


@query("""WITH RECURSIVE q AS (SELECT c_nationkey AS workspace, c_custkey AS source, c_custkey % 50 AS chunks, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
h AS (SELECT s_nationkey AS workspace, count(*) AS have FROM supplier GROUP BY 1),
r AS (SELECT n.n_nationkey AS workspace, 0::BIGINT AS n, coalesce(h.have, 0) AS used, NULL::BIGINT AS source, NULL::BIGINT AS chunks, false AS ok FROM nation n LEFT JOIN h ON h.workspace = n.n_nationkey
  UNION ALL SELECT q.workspace, q.n, CASE WHEN r.used + q.chunks <= 500 THEN r.used + q.chunks ELSE r.used END, q.source, q.chunks, r.used + q.chunks <= 500 FROM r JOIN q ON q.workspace = r.workspace AND q.n = r.n + 1)
SELECT workspace, CAST(source AS VARCHAR) AS source, chunks, CASE WHEN ok THEN 'ready' ELSE 'failed' END AS status FROM r WHERE n > 0""")
def quota_filter(s, d):
    """Sources of each workspace while their chunks fit, in order."""
    new = table(s, d, "customer").select(F.col("c_nationkey").alias("workspace"), F.col("c_custkey").alias("source"), F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 50).alias("chunks"))
    have = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("workspace")).agg(F.count("*").alias("chunks"))
    return ingest.within_quota(new, have, table(s, d, "nation").select(F.col("n_nationkey").alias("workspace"), F.lit(500).alias("chunk_limit")))


BILLING = """
WITH RECURSIVE e AS (SELECT event_id AS seq, 'acct_' || user_id AS account, 'cus_' || user_id AS cus, 'sub_' || user_id AS sub, 'price_' || event_id % 4 AS price, ['starter', 'growth', 'pro', NULL][event_id % 4 + 1] AS price_plan,
    ['active', 'past_due', 'unpaid'][event_id % 3 + 1] AS status, event_type AS kind, event_id % 2 = 0 AS ending, 1704067200 + event_id AS until, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT DISTINCT account, 0::BIGINT AS n, 'free' AS plan, '' AS st, '' AS cus, '' AS sub, '' AS price, false AS ending, '' AS until, '' AS note FROM e
  UNION ALL SELECT account, n, CASE how WHEN 'deleted' THEN 'free' WHEN 'mapped' THEN CASE WHEN status IN ('active', 'past_due') THEN price_plan ELSE 'free' END ELSE plan END,
    CASE how WHEN 'deleted' THEN 'canceled' WHEN 'mapped' THEN status WHEN 'failed' THEN 'past_due' ELSE st END, CASE how WHEN 'checkout' THEN e_cus ELSE cus END,
    CASE how WHEN 'checkout' THEN e_sub WHEN 'mapped' THEN e_sub WHEN 'deleted' THEN '' ELSE sub END, CASE how WHEN 'mapped' THEN e_price WHEN 'deleted' THEN '' ELSE price END,
    CASE how WHEN 'mapped' THEN e_ending WHEN 'deleted' THEN false ELSE ending END, CASE how WHEN 'mapped' THEN strftime(make_timestamp(e_until * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE until END,
    CASE how WHEN 'checkout' THEN 'linked stripe customer to account ' || account WHEN 'failed' THEN 'payment failed; plan unchanged pending Stripe retries' WHEN 'nobody' THEN 'no account for customer ' || e_cus WHEN 'unknown' THEN 'no account for subscription ' || e_sub
      WHEN 'deleted' THEN 'downgraded to free' WHEN 'unmapped' THEN 'unmapped price ' || e_price ELSE 'plan=' || CASE WHEN status IN ('active', 'past_due') THEN price_plan ELSE 'free' END || ' status=' || status END
  FROM (SELECT r.account, e.n, r.plan, r.st, r.cus, r.sub, r.price, r.ending, r.until, e.cus AS e_cus, e.sub AS e_sub, e.price AS e_price, e.price_plan, e.status, e.ending AS e_ending, e.until AS e_until,
      CASE WHEN e.kind = 'purchase' THEN 'checkout' WHEN e.kind = 'error' THEN CASE WHEN r.cus = e.cus THEN 'failed' ELSE 'nobody' END WHEN r.sub <> e.sub AND r.cus <> e.cus THEN 'unknown'
        WHEN e.kind = 'view' THEN 'deleted' WHEN e.price_plan IS NULL THEN 'unmapped' ELSE 'mapped' END AS how FROM r JOIN e ON e.account = r.account AND e.n = r.n + 1))
"""


def _billing(s, d):
    """Accounts and ledger after all events of the test stream, which names accounts in turn."""
    e = table(s, d, "events")
    kind = F.create_map(*(F.lit(x) for p in {"click": "customer.subscription.updated", "purchase": "checkout.session.completed", "error": "invoice.payment_failed", "signup": "customer.subscription.created", "view": "customer.subscription.deleted"}.items() for x in p))
    user = F.col("user_id").cast("string")
    events = e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("seq"), kind[F.col("event_type")].alias("type"), F.concat(F.lit("sub_"), user).alias("object_id"),
        F.element_at(F.array(F.lit("active"), F.lit("past_due"), F.lit("unpaid")), (F.col("event_id") % 3 + 1).cast("int")).alias("status"), F.concat(F.lit("acct_"), user).alias("account_id"),
        F.concat(F.lit("cus_"), user).alias("customer_id"), F.concat(F.lit("sub_"), user).alias("subscription_id"), F.concat(F.lit("price_"), (F.col("event_id") % 4).cast("string")).alias("price_id"),
        (F.col("event_id") % 2 == 0).alias("cancel_at_period_end"), (F.lit(1704067200) + F.col("event_id")).alias("period_end"),
    )
    accounts = e.select(F.concat(F.lit("acct_"), user).alias("account")).distinct().select("account", F.lit("free").alias("plan"), *(F.lit("").alias(c) for c in ("subscription_status", "stripe_customer_id", "stripe_subscription_id", "stripe_price_id")))
    prices = s.createDataFrame([("price_0", "starter"), ("price_1", "growth"), ("price_2", "pro")], "price_id string, price_plan string")
    return billing.apply_events(accounts, events, prices)


@query(f"""{BILLING} SELECT account, plan, st AS subscription_status, cus AS stripe_customer_id, sub AS stripe_subscription_id, price AS stripe_price_id, ending AS cancel_at_period_end, until AS current_period_end
FROM r QUALIFY row_number() OVER (PARTITION BY account ORDER BY n DESC) = 1""")
def billing_fold(s, d):
    return _billing(s, d)[0]


@query(f"{BILLING}, k AS (SELECT account, n, note FROM r WHERE n > 0) SELECT CAST(e.seq AS VARCHAR) AS event_id, k.note AS result FROM k JOIN e ON e.account = k.account AND e.n = k.n")
def billing_ledger(s, d):
    return _billing(s, d)[1].select("event_id", "result")


@query("""WITH k AS (SELECT l_orderkey AS o, l_linenumber AS i, 'u' || l_partkey AS url, 'r' || l_suppkey AS reason FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY i, url, reason) AS n FROM k), c AS (SELECT o, count(*) AS total FROM k GROUP BY o)
SELECT r.o, c.total || ' page(s) were not indexed: ' || string_agg(url || ' (' || reason || ')', '; ' ORDER BY n) FILTER (WHERE n <= 5) || CASE WHEN c.total > 5 THEN 'and ' || (c.total - 5) || ' more' ELSE '' END AS summary
FROM r JOIN c ON r.o = c.o GROUP BY r.o, c.total""")
def skipped_summary(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"), F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("reason"))
    return ingest.skipped_summary(rows, "o", "i")
