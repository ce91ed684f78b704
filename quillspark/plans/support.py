"""Queries over lookups, writes, small functions and literal cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import colors, times
from quillspark.functions import text as tx
from quillspark.functions import url as ur
from quillspark.operators import analytics, billing, chunking, conversations, embedding, records, retrieval, tenancy, usage
from quillspark.plans.views import table, view, with_views
from quillspark.sources import frames, schemas
from quillspark.sources.shared import scratch_path
from quillspark.streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


# --- lookups


@query("SELECT conversation, status FROM v_conversations WHERE workspace = 3 AND status <> 'closed' ORDER BY created_ms DESC, conversation LIMIT 5 OFFSET 2")
def records_page(s, d):
    found = records.find(view(s, d, "conversations"), (F.col("workspace") == 3) & (F.col("status") != "closed"), F.desc("created_ms"), "conversation", limit=5, offset=2)
    return found.select("conversation", "status")


@query("SELECT conversation, status, language FROM v_conversations WHERE conversation = 10")
def record_by_id(s, d):
    return records.by_id(view(s, d, "conversations"), "conversation", 10).select("conversation", "status", "language")


@query("SELECT conversation, status FROM v_conversations WHERE workspace = 2 ORDER BY created_ms DESC LIMIT 1")
def record_first(s, d):
    return records.first(view(s, d, "conversations"), F.col("workspace") == 2, F.desc("created_ms")).select("conversation", "status")


VISITED = "SELECT conversation, workspace, status, 'v' || conversation % 5 AS visitor FROM v_conversations"


@query(f"SELECT conversation, status FROM ({VISITED}) WHERE workspace = 1 AND visitor = 'v4'")
def owned_conversations(s, d):
    rows = view(s, d, "conversations").withColumn("visitor", F.concat(F.lit("v"), (F.col("conversation") % 5).cast("string")))
    return conversations.owned(rows, 1, "v4").select("conversation", "status")


@query("""WITH m AS (SELECT conversation, count(*) AS messages FROM v_messages GROUP BY 1), l AS (SELECT conversation, count(*) AS leads FROM v_leads GROUP BY 1)
SELECT c.conversation, c.status, m.messages, coalesce(l.leads, 0) AS leads FROM v_conversations c JOIN m ON c.conversation = m.conversation LEFT JOIN l ON c.conversation = l.conversation""")
def inbox_detail(s, d):
    return conversations.inbox_detail(view(s, d, "conversations"), view(s, d, "messages"), view(s, d, "leads"))


@query("SELECT m.workspace, m.usr, m.role, u.email FROM v_memberships m JOIN v_users u ON m.usr = u.usr")
def team_view(s, d):
    return tenancy.team(view(s, d, "memberships"), view(s, d, "users")).select("workspace", F.col("user").alias("usr"), "role", "email")


@query("SELECT m.workspace, u.email FROM v_memberships m JOIN v_users u ON m.usr = u.usr WHERE u.usr % 3 <> 0")
def member_emails(s, d):
    users = view(s, d, "users").withColumn("email", F.when(F.col("user") % 3 == 0, "").otherwise(F.col("email")))
    return tenancy.member_emails(view(s, d, "memberships"), users)


@query("""SELECT i.email, w.name, CASE WHEN u.usr % 2 = 0 THEN 'Ann ' || u.usr ELSE u.email END AS inviter, CASE WHEN i.expires_ms > 30000 THEN 200 ELSE 410 END AS status
FROM v_invitations i JOIN v_workspaces w ON i.workspace = w.workspace LEFT JOIN v_users u ON i.created_ms % 120 = u.usr""")
def invitation_preview(s, d):
    users = view(s, d, "users").withColumn("name", F.when(F.col("user") % 2 == 0, F.concat(F.lit(" Ann "), F.col("user").cast("string"), F.lit(" "))).otherwise("  "))
    asked = view(s, d, "invitations").withColumn("invited_by", F.col("created_ms") % 120)
    seen = tenancy.invitation_preview(asked.withColumnRenamed("email", "invited"), view(s, d, "workspaces"), users, 30000)
    return seen.select(F.col("invited").alias("email"), "name", "inviter", "status")


@query("""WITH u AS (SELECT o_custkey AS account, count(*) AS used, count(*) FILTER (WHERE o_orderkey % 5 = 0) * 0.02 AS over FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1995-03' GROUP BY 1),
a AS (SELECT c_custkey AS account, CASE c_custkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'starter' ELSE 'growth' END AS plan FROM customer)
SELECT a.account, a.plan, coalesce(u.used, 0) AS used, CASE a.plan WHEN 'free' THEN 50 WHEN 'starter' THEN 1000 ELSE 4000 END::BIGINT AS allowance, coalesce(round(u.over, 6), 0)::DOUBLE AS overage_usd, a.account % 2 = 0 AS has_customer FROM a LEFT JOIN u ON a.account = u.account""")
def billing_summary(s, d):
    plan = F.element_at(F.array(F.lit("free"), F.lit("starter"), F.lit("growth")), (F.col("c_custkey") % 3 + 1).cast("int"))
    accounts = table(s, d, "customer").select(F.col("c_custkey").alias("account"), plan.alias("plan"), F.when(F.col("c_custkey") % 2 == 0, "cus").alias("stripe_customer_id"))
    limits = s.createDataFrame([("free", 50), ("starter", 1000), ("growth", 4000)], "plan string, allowance bigint")
    return usage.billing_summary(accounts, usage.monthly_usage(view(s, d, "replies")), limits, "1995-03").withColumn("overage_usd", F.round("overage_usd", 6))


@query("""SELECT e.conversation, e.workspace, 'A visitor is waiting — ' || w.name AS subject, CASE WHEN e.lead % 2 = 0 THEN 'lead' || e.lead ELSE '' END AS contact
FROM (SELECT conversation, max(workspace) AS workspace, max(lead) AS lead FROM v_leads GROUP BY 1) e JOIN v_workspaces w ON e.workspace = w.workspace""")
def escalation_notices(s, d):
    leads = view(s, d, "leads")
    escalations = leads.groupBy("conversation").agg(F.max("workspace").alias("workspace"), F.max("lead").alias("lead"))
    contacts = leads.where("lead % 2 = 0").select("lead", F.concat(F.lit("lead"), F.col("lead").cast("string")).alias("contact"))
    return conversations.escalation_notices(escalations, view(s, d, "workspaces"), contacts)


@query("SELECT s_suppkey AS id, s_name AS title, 'website' AS type, '' AS status, '' AS error, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey ELSE 0 END::BIGINT AS pages FROM supplier ORDER BY s_suppkey DESC")
def source_views(s, d):
    """The allowed fields of sources, newest first."""
    rows = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("website").alias("type"), F.lit(None).cast("string").alias("status"), F.lit("").alias("error"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey")).alias("pages"), F.col("s_acctbal").alias("secret"))
    return frames.source_view(rows.orderBy(F.desc("id")))


WIDGET = "'wk_' || substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', 1 + CAST(n_nationkey AS INTEGER), 1) || repeat('0', 25)"


@query(rf"""WITH w AS (SELECT n_nationkey AS workspace, {WIDGET} AS k, n_nationkey % 3 AS m FROM nation)
SELECT r.c_custkey AS request, w.workspace FROM customer r JOIN w ON w.workspace = r.c_nationkey WHERE r.c_custkey % 4 <> 0 AND (w.m = 0 OR (w.m = 1 AND r.c_custkey % 2 = 0))""")
def widget_lookup(s, d):
    """Requests by malformed and known keys, from allowed and other origins."""
    domains = F.when(F.col("n_nationkey") % 3 == 0, '["www.a.example", "https://b.example/x"]').when(F.col("n_nationkey") % 3 == 1, '["a.example"]').otherwise("not json")
    workspaces = table(s, d, "nation").select(F.col("n_nationkey").alias("workspace"), F.expr(WIDGET).alias("widget_key"), domains.alias("allowed_domains"))
    asked = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.when(F.col("c_custkey") % 4 == 0, "wk_short").otherwise(F.expr(WIDGET))
    origin = F.when(F.col("c_custkey") % 2 == 0, "https://A.example:8080").otherwise("http://www.b.example")
    return frames.resolve_widgets(asked.select(F.col("c_custkey").alias("request"), key.alias("key"), origin.alias("origin")), workspaces)


# --- writes


@query("SELECT workspace_id AS workspace, count(*) AS vectors, 64 AS dims FROM v_vectors GROUP BY 1")
def index_round_trip(s, d):
    """The index written by tenant and read again."""
    path = scratch_path(s, "index")
    schemas.write_vectors(view(s, d, "vectors").withColumnRenamed("workspace_id", "workspace"), path, 64)
    return s.read.parquet(path).groupBy(F.col("workspace").cast("int").alias("workspace")).agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dims"))


@query("""SELECT e.event_id AS request, CASE WHEN c.conversation IS NULL THEN 'new-' || e.event_id ELSE CAST(e.user_id AS VARCHAR) END AS conversation, c.conversation IS NULL AS created
FROM events e LEFT JOIN v_conversations c ON c.conversation = e.user_id AND c.workspace = e.user_id % 9""")
def find_or_create(s, d):
    asked = table(s, d, "events").select(F.col("event_id").alias("request"), (F.col("user_id") % 9).alias("workspace"), F.col("user_id").alias("conversation"), F.lit("v").alias("visitor"), F.lit("en").alias("language"))
    return conversations.find_or_create(asked, view(s, d, "conversations")).select("request", "conversation", "created")


@query("""SELECT 'new-' || e.event_id AS conversation, e.user_id % 9 AS workspace, 'website' AS channel, 'en' AS language, 'active' AS status, 'v' AS visitor
FROM events e WHERE NOT EXISTS (SELECT 1 FROM v_conversations c WHERE c.conversation = e.user_id AND c.workspace = e.user_id % 9)""")
def opened_conversations(s, d):
    asked = table(s, d, "events").select(F.col("event_id").alias("request"), (F.col("user_id") % 9).alias("workspace"), F.col("user_id").alias("conversation"), F.lit("v").alias("visitor"), F.lit("en").alias("language"))
    return conversations.opened(conversations.find_or_create(asked, view(s, d, "conversations")))


@query("""SELECT conversation, turn, CASE WHEN role = 'assistant' THEN '["c' || conversation || '","c' || turn || '"]' END AS sources_used, nullif(outcome, '') AS outcome FROM v_messages""")
def saved_messages(s, d):
    ids = F.array(F.concat(F.lit("c"), F.col("conversation").cast("string")), F.concat(F.lit("c"), F.col("turn").cast("string")))
    rows = view(s, d, "messages").withColumn("sources", F.when(F.col("role") == "assistant", ids))
    return conversations.saved_messages(rows).select("conversation", "turn", "sources_used", "outcome")


ASKED = "SELECT conversation, max(lead) AS lead FROM v_leads WHERE conversation % 2 = 0 GROUP BY 1"
HELD = "SELECT conversation, 1 AS lead, CASE conversation % 3 WHEN 0 THEN 'resolved' ELSE 'claimed' END AS status FROM v_conversations WHERE conversation % 5 < 2"


@query(f"""WITH a AS ({ASKED}), h AS ({HELD}) SELECT coalesce(a.conversation, h.conversation) AS conversation, coalesce(a.lead, h.lead) AS lead,
  CASE WHEN h.status IS NULL OR (h.status = 'resolved' AND a.lead IS NOT NULL) THEN 'pending' ELSE h.status END AS status, h.status IS NOT NULL AND a.lead IS NOT NULL AS already_open FROM a FULL JOIN h ON a.conversation = h.conversation""")
def escalations(s, d):
    return _escalated(s, d)[0]


@query(f"""WITH a AS ({ASKED}) SELECT c.conversation, CASE WHEN a.lead IS NOT NULL AND c.status = 'active' THEN 'escalated' ELSE c.status END AS status FROM v_conversations c LEFT JOIN a ON a.conversation = c.conversation""")
def escalated_conversations(s, d):
    return _escalated(s, d)[1].select("conversation", "status")


def _escalated(s, d):
    held = view(s, d, "conversations").where("conversation % 5 < 2").select("conversation", F.lit(1).cast("long").alias("lead"), F.when(F.col("conversation") % 3 == 0, "resolved").otherwise("claimed").alias("status"))
    asked = view(s, d, "leads").where("conversation % 2 = 0").withColumn("seq", F.col("lead"))
    return conversations.escalate(asked, held, view(s, d, "conversations"))


GAP = "SELECT seq AS gap, workspace, question, answered FROM v_questions"


@query(f"""WITH g AS ({GAP}), t AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY gap) AS n FROM g WHERE gap % 3 = 0)
SELECT g.gap, g.answered OR coalesce(t.n <= 4, false) AS answered FROM g LEFT JOIN t ON g.gap = t.gap""")
def answered_gaps(s, d):
    gaps = view(s, d, "questions").select(F.col("seq").alias("gap"), "workspace", "question", "answered")
    answers = gaps.select("gap", F.when(F.col("gap") % 3 == 0, "Yes.").otherwise("").alias("answer"))
    room = s.range(8).select(F.col("id").alias("workspace"), F.lit(4).alias("left"))
    return usage.answer_gaps(gaps, answers, room)[1].select("gap", "answered")


@query(f"""WITH o AS (SELECT m.usr, w.account FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY created_ms, workspace) AS n FROM v_memberships WHERE role = 'owner') m JOIN v_workspaces w ON m.workspace = w.workspace WHERE n = 1),
r AS (SELECT c_custkey AS seq, c_custkey % 120 AS usr, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS name FROM customer), j AS (SELECT r.*, o.account FROM r LEFT JOIN o ON r.usr = o.usr),
p AS (SELECT *, sum(CASE WHEN name <> '' AND account IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY account ORDER BY seq) AS place FROM j)
SELECT usr, seq, account, CASE WHEN name = '' THEN 'a workspace name is required' WHEN account IS NULL THEN 'only the account owner can add a workspace' WHEN place > 3 * account THEN 'no slots left' ELSE 'created' END AS result FROM p""")
def created_workspaces(s, d):
    asked = table(s, d, "customer").select(F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 120).alias("user"), F.when(F.col("c_custkey") % 7 == 0, "  ").otherwise(F.col("c_name")).alias("name"))
    limits = table(s, d, "region").select(F.col("r_regionkey").alias("account"), (5 + 3 * F.col("r_regionkey")).alias("max_workspaces"))
    return tenancy.create_workspaces(asked, view(s, d, "memberships"), view(s, d, "workspaces"), limits).select(F.col("user").alias("usr"), "seq", "account", "result")


@query("""WITH RECURSIVE m AS (SELECT DISTINCT w.account, m.usr FROM v_memberships m JOIN v_workspaces w ON m.workspace = w.workspace), k AS (SELECT account, count(*) AS n, list(usr) AS people FROM m GROUP BY 1),
a AS (SELECT i.created_ms + 100000 * t.t AS seq, i.created_ms AS invitation, i.created_ms % 97 AS usr, i.workspace, i.email, i.expires_ms, w.account FROM v_invitations i JOIN v_workspaces w ON i.workspace = w.workspace, (VALUES (0), (1)) t(t)),
q AS (SELECT a.*, u.email AS own, row_number() OVER (PARTITION BY a.account ORDER BY a.seq) AS n, EXISTS (SELECT 1 FROM v_memberships x WHERE x.workspace = a.workspace AND x.usr = a.usr) AS inside FROM a JOIN v_users u ON a.usr = u.usr),
r AS (SELECT DISTINCT q.account, 0::BIGINT AS n, k.people AS people, k.n + q.account % 3 AS most, []::BIGINT[] AS used, []::VARCHAR[] AS joined, NULL::BIGINT AS seq, NULL::BIGINT AS invitation, NULL::BIGINT AS usr, '' AS result FROM q JOIN k ON k.account = q.account
  UNION ALL SELECT account, n, CASE WHEN result = 'joined' AND NOT list_contains(people, usr) THEN list_append(people, usr) ELSE people END, most, CASE WHEN result IN ('joined', 'already a member') THEN list_append(used, invitation) ELSE used END,
    CASE WHEN result = 'joined' THEN list_append(joined, place) ELSE joined END, seq, invitation, usr, result
  FROM (SELECT r.account, q.n, r.people, r.most, r.used, r.joined, q.seq, q.invitation, q.usr, q.workspace || '/' || q.usr AS place,
      CASE WHEN list_contains(r.used, q.invitation) THEN 'not found' WHEN q.expires_ms <= 30000 THEN 'expired' WHEN lower(q.email) <> lower(q.own) THEN 'for another address' WHEN q.inside OR list_contains(r.joined, q.workspace || '/' || q.usr) THEN 'already a member'
        WHEN q.account = 0 THEN 'not on this plan' WHEN NOT list_contains(r.people, q.usr) AND len(r.people) >= r.most THEN 'team is full' ELSE 'joined' END AS result FROM r JOIN q ON q.account = r.account AND q.n = r.n + 1))
SELECT seq, invitation, usr, result FROM r WHERE n > 0""")
def accepted_invitations(s, d):
    """Every invitation tried twice, in order, in accounts with none to two seats left."""
    asked = view(s, d, "invitations").select(F.col("created_ms").alias("invitation"), (F.col("created_ms") % 97).alias("user"), "workspace", "email", "expires_ms", F.lit("agent").alias("role"), "created_ms")
    asked = asked.withColumn("seq", F.explode(F.array(F.col("created_ms"), F.col("created_ms") + 100000)))
    memberships, workspaces = view(s, d, "memberships"), view(s, d, "workspaces")
    seats = tenancy.account_members(memberships, workspaces).groupBy("account").agg(F.count("*").alias("n"))
    limits = seats.select("account", (F.col("n") + F.col("account") % 3).alias("max_members"), (F.col("account") > 0).alias("invites"))
    return tenancy.accept_invitations(asked, view(s, d, "users"), memberships, workspaces, limits, 30000).select("seq", "invitation", F.col("user").alias("usr"), "result")


@query("SELECT created_ms AS invitation, workspace FROM v_invitations WHERE created_ms % 4 <> 0")
def left_invitations(s, d):
    asked = view(s, d, "invitations").select(F.col("created_ms").alias("invitation"), "workspace")
    return tenancy.without_invitations(asked, asked.where("invitation % 4 = 0"))


@query("""WITH r AS (SELECT o_custkey AS account, arg_max(o_orderkey % 40 - 10, o_orderkey) AS cap FROM orders WHERE o_orderkey % 40 - 10 >= 0 GROUP BY 1)
SELECT c.c_custkey AS account, coalesce(r.cap, 5)::DOUBLE AS hard_cap_usd FROM customer c LEFT JOIN r ON r.account = c.c_custkey""")
def spending_caps(s, d):
    asked = table(s, d, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 40 - 10).cast("double").alias("cap"))
    return usage.set_caps(table(s, d, "customer").select(F.col("c_custkey").alias("account"), F.lit(5.0).alias("hard_cap_usd")), asked)


@query("SELECT c_custkey AS usr, 'w-' || c_custkey AS workspace, 'owner' AS role FROM customer")
def provisioned(s, d):
    users = table(s, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_name").alias("name"), F.lit("a@b.example").alias("email"))
    return tenancy.provision(users)["memberships"].select(F.col("user").alias("usr"), "workspace", "role")


@query("SELECT workspace, count(*) AS members FROM v_memberships WHERE workspace <> 7 GROUP BY 1")
def deleted_workspace(s, d):
    kept = tenancy.without_workspace({"memberships": view(s, d, "memberships")}, view(s, d, "workspaces"), 7, 3)
    return kept["memberships"].groupBy("workspace").agg(F.count("*").alias("members"))


# --- counts and limits


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE greatest(c_custkey % 5 * 3 - c_custkey % 11, 0) END AS slots, c_custkey % 5 = 0 OR c_custkey % 11 < c_custkey % 5 * 3 AS may_add FROM customer""")
def source_limits(s, d):
    used, limit = F.col("c_custkey") % 11, F.col("c_custkey") % 5 * 3
    return table(s, d, "customer").select("c_custkey", tenancy.slots_left(used, limit).alias("slots"), tenancy.under_source_limit(used, limit).alias("may_add"))


@query("""WITH c AS (SELECT l_suppkey AS source, count(*) AS chunks, count(DISTINCT l_orderkey) AS pages FROM lineitem GROUP BY 1)
SELECT s_suppkey AS source, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN c.pages ELSE c.chunks END, 0) AS pages FROM supplier LEFT JOIN c ON c.source = s_suppkey""")
def source_pages(s, d):
    sources = table(s, d, "supplier").select(F.col("s_suppkey").alias("source"), F.when(F.col("s_suppkey") % 2 == 0, "website").otherwise("text").alias("type"))
    chunks = table(s, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("page"))
    return usage.source_pages(sources, chunks).select("source", "pages")


@query("SELECT (SELECT count(*) FROM customer) AS subscribers, (SELECT count(DISTINCT c_custkey % 200) FROM customer) AS conversations, (SELECT sum(greatest(n - 16, 0))::BIGINT FROM (SELECT count(*) AS n FROM events GROUP BY user_id)) AS dropped")
def hub_gauges(s, d):
    watching = table(s, d, "customer").select(F.col("c_custkey").alias("subscriber"), (F.col("c_custkey") % 200).alias("conversation"))
    return live.gauges(watching, live.deliver(table(s, d, "events").select(F.col("user_id").alias("subscriber"))))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'starter' WHEN 1 THEN 'growth' END AS price_plan, CASE WHEN p_size % 4 > 1 THEN 'unmapped price p' || p_size % 4 END AS told FROM part")
def price_plans(s, d):
    prices = s.createDataFrame([("p0", "starter"), ("p1", "growth")], "price_id string, price_plan string")
    parts = table(s, d, "part").withColumn("price_id", F.concat(F.lit("p"), (F.col("p_size") % 4).cast("string")))
    return billing.priced(parts, prices).select("p_partkey", "price_plan", F.when(F.col("price_plan").isNull(), billing.unmapped(F.col("price_id"))).alias("told"))


@query("""WITH v AS (SELECT workspace_id, chunk_id, row_number() OVER (PARTITION BY workspace_id ORDER BY chunk_id) - 1 AS n FROM v_vectors)
SELECT workspace_id, chunk_id, n // 96 AS batch, n % 96 AS index FROM v""")
def embedding_batches(s, d):
    """Requests matched with replies that come in another order."""
    asked = embedding.embedding_batches(view(s, d, "vectors"), "workspace_id", "chunk_id")
    replies = asked.select("workspace_id", "batch", "index", "embedding").repartition(3, "index")
    found = embedding.embedded(asked.drop("embedding"), replies, ["workspace_id"], 64)
    return found.where("embedding IS NOT NULL").select("workspace_id", "chunk_id", F.col("batch").cast("long").alias("batch"), F.col("index").cast("long").alias("index"))


@query(r"""WITH l AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id, n) - 1 AS position, CASE WHEN doc_id % 3 = 0 THEN line ELSE 'Page ' || doc_id || ' ' || lang || chr(10) || chr(10) || line END AS text FROM l""")
def titled_chunks(s, d):
    """The lines of documents as chunks of pages, under titles that need tidying or are blank."""
    title = F.when(F.col("doc_id") % 3 == 0, " \n").otherwise(F.concat(F.lit("  Page  "), F.col("doc_id").cast("string"), F.lit(" \t"), "lang"))
    lines = table(s, d, "documents").select("doc_id", "source", title.alias("title"), F.posexplode(F.split("text", "\n", -1)).alias("position", "text"))
    return chunking.titled_chunks(lines, "source", "doc_id", "title").select("doc_id", "source", F.col("position").cast("long").alias("position"), "text")


# --- billing events


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, 'customer.subscription.updated' AS type, 'sub_' || user_id AS object_id, 'acct_' || user_id AS account_id, 'cus_' || user_id AS customer_id,
  CASE WHEN event_id % 2 = 0 THEN 'price_1' ELSE '' END AS price_id, CASE WHEN event_id % 2 = 0 THEN 1704067200 + event_id END AS period_end FROM events""")
def webhook_events(s, d):
    """Webhook bodies, with the customer as an object or as an id, and their fields read back."""
    user = F.col("user_id").cast("string")
    plain = F.concat(F.lit('"cus_'), user, F.lit('"'))
    customer = F.when(F.col("event_id") % 3 == 0, plain).otherwise(F.concat(F.lit('{"id": '), plain, F.lit("}")))
    end = (F.lit(1704067200) + F.col("event_id")).cast("string")
    items = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('[{"price": {"id": "price_1"}, "current_period_end": '), end, F.lit("}]"))).otherwise("[]")
    body = F.concat(
        F.lit('{"id": "'), F.col("event_id").cast("string"), F.lit('", "type": "customer.subscription.updated", "created": 1, "data": {"object": {"id": "sub_'), user, F.lit('", "status": "active", "customer": '), customer,
        F.lit(', "metadata": {"account_id": "acct_'), user, F.lit('"}, "items": {"data": '), items, F.lit("}}}}"),
    )
    return billing.parse_events(table(s, d, "events").select(body.alias("body"))).select("event_id", "type", "object_id", "account_id", "customer_id", "price_id", "period_end")


SECRET, SIGNED_AT = "whsec_test", 1704067200
PADS = [bytes(x ^ pad for x in SECRET.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


def _signed(text: Column, key: int = 0) -> Column:
    """HMAC of a text under the secret, by its definition; ``key`` spoils the secret."""
    inner, outer = (F.unhex(F.lit(p if not key else f"{key:02x}{p[2:]}")) for p in PADS)
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)


@query("SELECT event_id, event_id % 8 IN (0, 1, 7) AS valid FROM events")
def webhook_signatures(s, d):
    """Deliveries signed well (alone, beside another signature, and at the last second), and with all that can be wrong."""
    at = F.when(F.col("event_id") % 8 == 5, SIGNED_AT - 301).when(F.col("event_id") % 8 == 7, SIGNED_AT - 300).otherwise(SIGNED_AT - F.col("user_id") % 200).cast("string")
    rows = table(s, d, "events").select("event_id", F.concat(F.lit('{"id": "'), F.col("event_id").cast("string"), F.lit('", "props": '), "props", F.lit("}")).alias("body"), at.alias("at"))
    signed = F.concat("at", F.lit("."), "body")
    good, bad = _signed(signed), _signed(signed, 7)
    head = F.concat(F.lit("t="), "at", F.lit(",v1="))
    headers = [F.concat(head, good), F.concat(head, bad, F.lit(",v1="), good), F.concat(head, bad), F.concat(F.lit("v1="), good), F.concat(F.lit("t="), "at", F.lit(",v0="), good), F.concat(head, good), F.concat(head, _signed(F.concat(signed, F.lit(" ")))), F.concat(head, good)]
    header = F.element_at(F.array(*headers), (F.col("event_id") % 8 + 1).cast("int"))
    return rows.select("event_id", billing.signature_valid(F.col("body"), header, SECRET, SIGNED_AT).alias("valid"))


@query("SELECT conversation, turn, 'message' AS event, role, text FROM v_messages WHERE role = 'human' UNION ALL SELECT conversation, NULL, 'status', status, NULL FROM v_conversations")
def framed_events(s, d):
    """Live events written as frames and read back, in the form that clients parse."""
    said = view(s, d, "messages").where("role = 'human'").select(F.lit("message").alias("event"), F.struct("conversation", "turn", "role", "text").alias("payload"))
    status = view(s, d, "conversations").select(F.lit("status").alias("event"), F.struct("conversation", F.lit(None).cast("long").alias("turn"), F.col("status").alias("role"), F.lit(None).cast("string").alias("text")).alias("payload"))
    path = scratch_path(s, "frames")
    frames.write_frames(said.unionByName(status), path, "event", "payload")
    return frames.read_frames(s, path, "conversation long, turn long, role string, text string").select("payload.conversation", "payload.turn", "event", "payload.role", "payload.text")


# --- times


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month FROM orders")
def month_starts(s, d):
    return table(s, d, "orders").select("o_orderkey", times.month_start(F.col("o_orderdate").cast("timestamp_ntz")).cast("timestamp_ntz").alias("month"))


STORED = """SELECT event_id, event_id % 8 AS kind, strftime(make_timestamp((1704067200 + event_id * 997) * 1000000), '%Y-%m-%d') AS day, strftime(make_timestamp((1704067200 + event_id * 997) * 1000000), '%H:%M:%S') AS clock, event_id % 1000 AS ms FROM events"""


@query(f"""WITH t AS ({STORED}) SELECT event_id, CASE WHEN kind < 3 THEN epoch_ms(CAST(day || ' ' || clock AS TIMESTAMP)) + CASE kind WHEN 2 THEN 0 ELSE ms END WHEN kind = 3 THEN epoch_ms(CAST(day || ' ' || clock AS TIMESTAMP)) + ms - 7200000 END AS ms FROM t""")
def parse_times(s, d):
    """Times as they are stored, with and without a zone, in RFC 3339, and in forms that are none."""
    e = table(s, d, "events").withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("event_id") * 997))
    wall = times.rfc3339(F.lit(1704067200) + F.col("event_id") * 997)
    day, clock, ms = F.substring(wall, 1, 10), F.substring(wall, 12, 8), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    forms = [join(day, " ", clock, ".", ms, "Z"), join(day, " ", clock, ".", ms), join(day, "T", clock, "Z"), join(day, "T", clock, ".", ms, "+02:00"), join(day, " ", clock), join(F.substring(day, 1, 5), "13-02 ", clock, ".", ms), F.lit(""), join(day, " soon")]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 8 + 1).cast("int"))
    return e.select("event_id", F.unix_millis(times.parse_time(text)).alias("ms"))


@query("SELECT event_id, strftime(make_timestamp((1704067200 + event_id * 997) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at, event_id * 1000 + 604800000 AS expires_ms FROM events")
def epoch_times(s, d):
    return table(s, d, "events").select("event_id", times.rfc3339(F.lit(1704067200) + F.col("event_id") * 997).alias("at"), times.invitation_expiry(F.col("event_id") * 1000).alias("expires_ms"))


# --- types, addresses and links of what is fetched

#: Content types with and without a charset, in either case; both engines read this.
TYPED = """SELECT event_id, concat(CASE WHEN event_id % 3 = 0 THEN upper(kind) ELSE kind END, CASE WHEN user_id % 2 = 0 THEN '; charset=utf-8' ELSE '' END) AS type
FROM (SELECT *, CASE event_id % 9 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/xhtml+xml' WHEN 3 THEN 'image/svg+xml' WHEN 4 THEN 'application/pdf' WHEN 5 THEN '' WHEN 6 THEN 'application/json' WHEN 7 THEN 'application/atom+xml' ELSE concat('application/', event_type) END AS kind FROM {events}) t"""


@query(f"SELECT event_id, type, lower(type) LIKE 'text/%' OR lower(type) LIKE '%xhtml%' OR lower(type) LIKE '%+xml%' AS textual FROM ({TYPED.replace('{events}', 'events')})")
def textual_types(s, d):
    return s.sql(TYPED, events=table(s, d, "events")).select("event_id", "type", ur.is_textual(F.col("type")).alias("textual"))


#: Addresses in special and ordinary ranges, mapped into IPv6, of IPv6, and malformed.
ADDRESSES = """SELECT event_id, kind, a, b, c, e, g, CASE WHEN kind < 5 THEN v4 WHEN kind = 5 THEN concat('::ffff:', v4) WHEN kind = 6 THEN concat(g, '::', CAST(e AS STRING)) ELSE concat(CAST(a + 300 AS STRING), '.', v4) END AS address
FROM (SELECT *, concat(CAST(a AS STRING), '.', CAST(b AS STRING), '.', CAST(c AS STRING), '.', CAST(e AS STRING)) AS v4 FROM (
  SELECT event_id, event_id % 8 AS kind, CASE user_id % 13 WHEN 0 THEN 10 WHEN 1 THEN 127 WHEN 2 THEN 172 WHEN 3 THEN 192 WHEN 4 THEN 169 WHEN 5 THEN 100 WHEN 6 THEN 198 WHEN 7 THEN 224 WHEN 8 THEN 0 WHEN 9 THEN 255 ELSE 8 + user_id % 80 END AS a,
    CASE event_id % 7 WHEN 0 THEN 168 WHEN 1 THEN 254 WHEN 2 THEN 0 WHEN 3 THEN 18 ELSE event_id % 256 END AS b, CASE event_id % 4 WHEN 0 THEN 0 ELSE event_id % 251 END AS c, event_id % 241 AS e,
    CASE event_id % 5 WHEN 0 THEN 'fe80' WHEN 1 THEN 'fd12' WHEN 2 THEN 'ff02' WHEN 3 THEN '2606' ELSE '2a00' END AS g FROM {events}) o) t"""
PRIVATE = "a IN (0, 10, 127) AND (a <> 0 OR (b = 0 AND c = 0 AND e = 0)) OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 169 AND b = 254 OR a = 100 AND b BETWEEN 64 AND 127 OR a = 192 AND b = 0 AND c = 0 OR a = 198 AND b IN (18, 19) OR a >= 224"


@query(f"SELECT event_id, address, CASE WHEN kind < 6 THEN NOT ({PRIVATE}) WHEN kind = 6 THEN g NOT IN ('fe80', 'fd12', 'ff02') ELSE false END AS public FROM ({ADDRESSES.replace('{events}', 'events')})")
def public_addresses(s, d):
    return s.sql(ADDRESSES, events=table(s, d, "events")).select("event_id", "address", ur.public_address("address").alias("public"))


#: Pages' URLs as they are, with other schemes, in capitals, without a host, and at addresses.
ASKED_URLS = """SELECT page_id, kind, address, public, CASE kind WHEN 0 THEN url WHEN 1 THEN upper(url) WHEN 2 THEN concat('ftp://', host, '/x') WHEN 3 THEN concat(host, '/x') WHEN 4 THEN 'https://' WHEN 5 THEN concat('file:///', host) ELSE concat('http://', address, ':8080/', CAST(page_id AS STRING)) END AS asked
FROM (SELECT page_id, url, page_id % 8 AS kind, split_part(split_part(url, '//', 2), '/', 1) AS host, CASE page_id % 3 WHEN 0 THEN concat('10.0.0.', CAST(page_id % 250 AS STRING)) WHEN 1 THEN concat('8.8.8.', CAST(page_id % 250 AS STRING)) ELSE '127.0.0.1' END AS address, page_id % 3 = 1 AS public FROM {pages}) t"""


@query(f"SELECT page_id, asked, kind IN (0, 1) OR (kind > 5 AND public) AS ok FROM ({ASKED_URLS.replace('{pages}', 'pages')})")
def checked_urls(s, d):
    return s.sql(ASKED_URLS, pages=table(s, d, "pages")).select("page_id", "asked", ur.checked_url(F.col("asked")).alias("ok"))


#: Links of every form on pages; what they mean is told from the parts of the page's URL.
HREFS = """SELECT page_id, url, page_id % 9 AS kind, CASE page_id % 9 WHEN 0 THEN concat('../b', CAST(page_id AS STRING)) WHEN 1 THEN '#top' WHEN 2 THEN concat('mailto:x', CAST(page_id AS STRING), '@y.example') WHEN 3 THEN concat('//b.example/p', CAST(page_id AS STRING), '#q')
  WHEN 4 THEN concat('?q=', CAST(page_id AS STRING)) WHEN 5 THEN concat('  /r', CAST(page_id AS STRING), ' ') WHEN 6 THEN '' WHEN 7 THEN 'javascript:void(0)' ELSE concat('http://c', CAST(page_id AS STRING), '.example') END AS href FROM {pages}"""


@query(f"""WITH h AS ({HREFS.replace('{pages}', 'pages')}), p AS (SELECT *, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM h),
f AS (SELECT *, regexp_extract(path, '^(.*/)[^/]*$', 1) AS folder FROM p)
SELECT page_id, href, CASE kind WHEN 0 THEN site || coalesce(nullif(regexp_replace(folder, '[^/]+/$', ''), ''), '/') || trim(href, './') WHEN 3 THEN scheme || ':' || split_part(href, '#', 1) WHEN 4 THEN site || path || href WHEN 5 THEN site || trim(href) WHEN 8 THEN href ELSE '' END AS url FROM f""")
def resolve_links(s, d):
    return s.sql(HREFS, pages=table(s, d, "pages")).select("page_id", "href", ur.resolve_url("url", "href").alias("url"))


#: Workspaces' settings: floors inside and outside (0, 1], as text, missing, and no JSON at all.
CONFIGS = """SELECT c_custkey, CASE kind WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '{{"name": "x"}}' WHEN 3 THEN '{{"similarityFloor": "high"}}' ELSE concat('{{"similarityFloor": ', CAST(tenths AS STRING), 'e-1, "name": "x"}}') END AS config, kind, tenths
FROM (SELECT c_custkey, c_custkey % 9 AS kind, c_custkey % 17 - 2 AS tenths FROM {customer}) t"""


@query(f"SELECT c_custkey, CASE WHEN kind > 3 AND tenths > 0 AND tenths <= 10 THEN tenths / 10.0::DOUBLE ELSE 0.35::DOUBLE END AS floor FROM ({CONFIGS.replace('{customer}', 'customer').replace('{{', '{').replace('}}', '}')})")
def workspace_floors(s, d):
    found = s.sql(CONFIGS, customer=table(s, d, "customer"))
    return found.select("c_custkey", retrieval.floor_of(F.col("config")).cast("double").alias("floor"))


@query("SELECT doc_id, text FROM documents UNION ALL SELECT -1, 'مرحبا'")
def decode_bodies(s, d):
    """Bodies in UTF-8 (undeclared or of unknown charset), UTF-16, Latin-1 where the text allows it, and Windows-1256."""
    part, latin = F.col("doc_id") % 4, F.rlike("text", F.lit(r"^[\x00-\x7F\xA0-\xFF]*$"))
    body = F.when(part == 0, F.encode("text", "UTF-16")).when((part == 3) & latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    kind = F.when(part == 0, "text/html; charset=utf-16").when((part == 3) & latin, 'text/html; Charset="ISO-8859-1"').when(part == 1, "text/html").otherwise("text/html; charset=none-such")
    own = s.createDataFrame([(-1, bytearray("مرحبا".encode("cp1256")), "text/html; charset=windows-1256")], "doc_id bigint, body binary, type string")
    docs = table(s, d, "documents").select("doc_id", body.alias("body"), kind.alias("type"))
    return docs.unionByName(own).select("doc_id", ur.decode_bytes("body", "type").alias("text"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 120 < 100 THEN c_custkey % 120 ELSE NULL END AS delay_s, CASE WHEN c_custkey % 120 >= 100 THEN 500 ELSE least(5000, greatest(500, (c_custkey % 120) * 100)) END AS delay_ms FROM customer")
def robots_delays(s, d):
    n = F.col("c_custkey") % 120
    told_delay = F.when(n < 100, F.concat((n / 10).cast("string"), F.lit(" seconds"))).otherwise("soon")
    seconds = ur.lenient_number(told_delay)
    return table(s, d, "customer").select("c_custkey", F.when(n < 100, F.round(seconds * 10).cast("long")).alias("delay_s"), ur.effective_delay(500, seconds).alias("delay_ms"))


FAILED = "SELECT doc_id, text, concat(CASE doc_id % 4 WHEN 0 THEN 'ingest: ' WHEN 1 THEN 'crawl: fetch: ' WHEN 2 THEN 'extract: ' ELSE '' END, substr(text, 1, 60 + doc_id % 40)) AS failed, concat(CASE WHEN doc_id % 2 = 0 THEN 'fetch page: ' ELSE '' END, substr(text, 1, 40 + doc_id % 220)) AS long FROM {documents}"


@query(rf"""WITH f AS ({FAILED.replace('{documents}', 'documents')}), c AS (SELECT *, CASE WHEN strlen(long) > 90 AND instr(long, ': ') > 0 THEN substr(long, instr(long, ': ') + 2) ELSE long END AS rest FROM f)
SELECT doc_id, substr(text, 1, 2000) AS cut, regexp_replace(failed, 'ingest: |crawl: |fetch: |extract: ', '', 'g') AS reason, CASE WHEN strlen(rest) > 180 THEN substr(rest, 1, 180) || '…' ELSE rest END AS error, ceil(length(text) / 60.0)::INTEGER AS pieces,
  CASE WHEN doc_id % 2 = 0 THEN 'we could not read any pages from this address' ELSE 'no pages could be indexed. ' || substr(text, 1, 20) END AS told FROM c""")
def short_texts(s, d):
    """Texts cut to size, and failures (made of the documents' own words) without their prefixes."""
    rows = s.sql(FAILED, documents=table(s, d, "documents"))
    told_text = tx.empty_crawl(F.col("doc_id") % 2, F.left("text", F.lit(20)))
    return rows.select("doc_id", tx.truncate(F.col("text"), 2000).alias("cut"), tx.short_reason(F.col("failed")).alias("reason"), tx.short_error(F.col("long")).alias("error"), F.size(tx.pieces(F.col("text"))).alias("pieces"), told_text.alias("told"))


@query("SELECT doc_id, '[ECHO]' || chr(10) || trim(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS reply FROM documents")
def echo_replies(s, d):
    docs = table(s, d, "documents")
    return docs.select("doc_id", tx.echo_reply(F.concat(F.lit("Rules.\n\nSOURCES:\n"), F.col("text"))).alias("reply"))


@query("""SELECT conversation, count(*) FILTER (WHERE trim(text) <> '') + 1 AS turns, count(*) FILTER (WHERE trim(text) <> '' AND role IN ('assistant', 'human')) AS by_assistant FROM v_messages GROUP BY 1""")
def model_turns(s, d):
    turns = view(s, d, "messages").groupBy("conversation").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    made = turns.select("conversation", conversations.model_turns(F.col("turns"), F.lit("And now?")).alias("m"))
    return made.select("conversation", F.size("m").cast("long").alias("turns"), F.size(F.filter("m", lambda t: t["role"] == "assistant")).cast("long").alias("by_assistant"))


@query("SELECT conversation * 100 + turn AS id, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, coalesce(outcome = 'refused', false) AS refused FROM v_messages WHERE turn % 3 <> 0")
def live_messages(s, d):
    rows = view(s, d, "messages").withColumn("id", F.when(F.col("turn") % 3 != 0, F.col("conversation") * 100 + F.col("turn")))
    return conversations.live_messages(rows).select("id", "role", "refused")


#: Keys of the right and of wrong length, with letters that keys don't have, and invitations.
KEYS = """SELECT c_custkey, CASE kind WHEN 0 THEN concat('wk_', substr(body, 1, 26)) WHEN 1 THEN concat('wk_', substr(body, 1, 25)) WHEN 2 THEN concat('wk_', substr(body, 1, 25), 'I') WHEN 3 THEN concat('inv_', substr(body, 1, 52)) WHEN 4 THEN concat('inv_', substr(body, 1, 51), 'U') WHEN 5 THEN concat('wk_', lower(substr(body, 1, 20)), 'ABCDEF') ELSE substr(body, 1, 26) END AS key, kind
FROM (SELECT c_custkey, c_custkey % 7 AS kind, upper({sha}) AS body FROM {{customer}}) t"""


@query(f"SELECT c_custkey, key, kind = 0 AS widget, kind = 3 AS invite, sha256(key) AS hash FROM ({KEYS.format(sha='sha256(CAST(c_custkey AS VARCHAR))').replace('{customer}', 'customer')})")
def key_shapes(s, d):
    rows = s.sql(KEYS.format(sha="sha2(CAST(c_custkey AS STRING), 256)"), customer=table(s, d, "customer"))
    return rows.select("c_custkey", "key", frames.is_widget_key(F.col("key")).alias("widget"), frames.is_invite(F.col("key")).alias("invite"), frames.token_hash(F.col("key")).alias("hash"))


@query("SELECT count(*) AS issued, count(*) AS widget_keys, count(*) AS invitations, 2 * count(*) AS different FROM customer")
def issued_keys(s, d):
    """New keys for every customer: all well formed, no two alike."""
    keys = table(s, d, "customer").select("c_custkey").withColumns({"key": frames.new_widget_key("c_custkey"), "token": frames.new_invite("c_custkey")})
    each = keys.select("key", "token", F.explode(F.array("key", "token")).alias("any"))
    n = lambda c: F.count_if(c)
    return each.agg((F.count("*") / 2).cast("long").alias("issued"), n(frames.is_widget_key(F.col("any"))).alias("widget_keys"), n(frames.is_invite(F.col("any"))).alias("invitations"), F.countDistinct("any").alias("different"))


WAITS = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN event_id % 1000 WHEN 2 THEN 1000 + event_id * 7 % 59000 WHEN 3 THEN 60000 + event_id * 991 % 3540000 ELSE 3600000 + event_id * 99991 % 900000000 END AS ms FROM {events}"


@query(f"""SELECT event_id, CASE WHEN ms IS NULL THEN '—' WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN (ms + 500) // 1000 || 's' WHEN ms < 3600000 THEN (ms + 30000) // 60000 || 'm'
  ELSE ((ms + 180000) // 360000) // 10 || '.' || ((ms + 180000) // 360000) % 10 || 'h' END AS label FROM ({WAITS.replace('{events}', 'events')})""")
def duration_labels(s, d):
    return s.sql(WAITS, events=table(s, d, "events")).select("event_id", analytics.duration_label(F.col("ms")).alias("label"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE CAST(floor(100.0 * (c_custkey % 7) / (c_custkey % 9) + 0.5) AS BIGINT) END AS pct, round((c_custkey % 200) * 0.02, 2) AS cost,
  CASE WHEN c_custkey % 6 - 1 <= 0 THEN 0 ELSE (c_custkey % 6 - 1) * 50 END AS left, c_custkey % 100 * 10 AS yearly, round((c_custkey % 100) * 10 / 12.0::DOUBLE, 2) AS monthly FROM customer""")
def percentages_and_costs(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        k, analytics.percent(k % 7, k % 9).alias("pct"), usage.overage_cost(k % 200).cast("double").alias("cost"), usage.replies_under_cap(F.lit(1.0), (k % 6).cast("double")).alias("left"), usage.annual_total(k % 100).alias("yearly"), usage.annual_monthly(k % 100).alias("monthly")
    )


NOUNS = {"en": {"one": "reply", "other": "replies"}, "ar": {"zero": "لا ردود", "one": "رد واحد", "two": "ردان", "few": "ردود", "many": "ردًا", "other": "رد"}}
COUNTED = "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'ar' ELSE 'en' END AS lang, CASE event_id % 5 WHEN 0 THEN event_id % 4 WHEN 1 THEN event_id % 120 WHEN 2 THEN event_id * 1009 ELSE event_id END AS n FROM {events}"


@query(f"""WITH k AS (SELECT *, n % 100 AS h, CASE WHEN n < 1000 THEN n || '' WHEN n < 1000000 THEN n // 1000 || ',' || lpad(n % 1000 || '', 3, '0') ELSE n // 1000000 || ',' || lpad(n // 1000 % 1000 || '', 3, '0') || ',' || lpad(n % 1000 || '', 3, '0') END AS told FROM ({COUNTED.replace('{events}', 'events')}))
SELECT event_id, lang, n, CASE WHEN lang = 'en' THEN told || CASE n WHEN 1 THEN ' reply' ELSE ' replies' END WHEN n = 0 THEN '{NOUNS['ar']['zero']}' WHEN n = 1 THEN '{NOUNS['ar']['one']}' WHEN n = 2 THEN '{NOUNS['ar']['two']}'
  WHEN h BETWEEN 3 AND 10 THEN told || ' {NOUNS['ar']['few']}' WHEN h BETWEEN 11 AND 99 THEN told || ' {NOUNS['ar']['many']}' ELSE told || ' {NOUNS['ar']['other']}' END AS label FROM k""")
def plural_labels(s, d):
    rows = s.sql(COUNTED, events=table(s, d, "events"))
    forms = lambda la: F.create_map(*(F.lit(x) for p in NOUNS[la].items() for x in p))
    label = F.when(F.col("lang") == "ar", tx.plural(F.col("lang"), F.col("n"), forms("ar"))).otherwise(tx.plural(F.col("lang"), F.col("n"), forms("en")))
    return rows.select("event_id", "lang", "n", label.alias("label"))


@query("""WITH c AS (SELECT DISTINCT p_size % 16 AS n FROM part), h AS (SELECT n, '#' || repeat(lower(hex(n * 17)), 3) AS color, n * 17 / 255.0::DOUBLE AS s FROM c),
l AS (SELECT n, color, CASE WHEN s <= 0.04045 THEN s / 12.92 ELSE pow((s + 0.055) / 1.055, 2.4) END AS y FROM h)
SELECT n, round(1.05 / (y + 0.05), 4) AS on_white, CASE WHEN 1.05 / (y + 0.05) >= (y + 0.05) / 0.05 THEN '#ffffff' ELSE '#000000' END AS best FROM l WHERE n > 0""")
def contrasts(s, d):
    """Contrast of greys with white, and the better of black and white on them."""
    grey = F.concat(F.lit("#"), F.repeat(F.lower(F.hex(F.col("n") * 17)), F.lit(3)))
    rows = table(s, d, "part").select((F.col("p_size") % 16).alias("n")).distinct().where("n > 0").withColumn("c", colors.normalize_accent(grey))
    return rows.select("n", F.round(colors.contrast_ratio(F.col("c"), F.lit("#ffffff")), 4).alias("on_white"), colors.contrast_on(F.col("c")).alias("best"))


@query("SELECT conversation, turn, outcome = 'refused' AS gap FROM v_messages WHERE role = 'assistant' AND conversation % 5 NOT IN (1, 2)")
def recorded_gaps(s, d):
    rows = view(s, d, "messages").where("role = 'assistant'")
    status = F.when(F.col("conversation") % 5 == 1, "escalated").when(F.col("conversation") % 5 == 2, "human").otherwise("active")
    made = conversations.replies(rows.withColumns({"status": status, "language": F.lit("en"), "verdict": F.lit("allow")}))
    return made.where("outcome <> 'human'").select("conversation", "turn", F.col("records_gap").alias("gap"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'dark' WHEN event_id % 3 = 1 THEN 'light' WHEN event_id % 256 * 299 + event_id * 7 % 256 * 587 + user_id % 256 * 114 < 128000 THEN 'dark' ELSE 'light' END AS theme FROM events""")
def page_themes(s, d):
    """The widget's theme on pages of every background."""
    setting = F.element_at(F.array(F.lit("dark"), F.lit("light"), F.lit("auto")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(s, d, "events").select("event_id", colors.page_theme(setting, F.col("event_id") % 256, F.col("event_id") * 7 % 256, F.col("user_id") % 256).alias("theme"))


@query("""SELECT conversation, turn, list_filter([CASE WHEN turn % 7 = 0 THEN 'role' END, CASE WHEN conversation % 5 = 0 THEN 'outcome' END], lambda x: x IS NOT NULL) AS bad FROM v_messages""")
def vocabulary_violations(s, d):
    """Columns of messages outside their vocabularies."""
    rows = view(s, d, "messages").withColumns({"role": F.when(F.col("turn") % 7 == 0, "robot").otherwise(F.col("role")), "outcome": F.when(F.col("conversation") % 5 == 0, "lost").otherwise(F.col("outcome"))})
    return rows.select("conversation", "turn", schemas.violations(rows, "messages").alias("bad"))


@query("""WITH l AS (SELECT conversation, max(lead) AS lead FROM v_leads GROUP BY 1), m AS (SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY created_ms DESC, turn DESC) AS back FROM v_messages)
SELECT c.conversation, c.status, m.turn, m.role, m.text, l.lead FROM v_conversations c JOIN m ON m.conversation = c.conversation AND m.back <= 50 LEFT JOIN l ON l.conversation = c.conversation WHERE c.status IN ('escalated', 'human')""")
def inbox_threads(s, d):
    """Conversations that wait for a person, with their last messages and the newest lead of each."""
    waiting = view(s, d, "conversations").where(F.col("status").isin("escalated", "human"))
    return conversations.inbox_threads(waiting, view(s, d, "messages"), view(s, d, "leads")).select("conversation", "status", "turn", "role", "text", "lead")


SINCE_MS = 1704067200000 + 3 * 86_400_000


@query(f"""SELECT w.workspace, (SELECT count(*) FROM supplier x WHERE x.s_nationkey = w.workspace) AS sources,
  (SELECT count(*) FROM v_messages m WHERE m.workspace = w.workspace AND m.role = 'assistant' AND m.created_ms >= epoch_ms(date_trunc('month', make_timestamp({SINCE_MS} * 1000)))) AS replies,
  (SELECT count(*) FROM v_conversations c WHERE c.workspace = w.workspace AND c.created_ms >= {SINCE_MS} - 2 * 86400000) AS conversations FROM v_workspaces w""")
def workspace_counts(s, d):
    """Of every workspace: sources, the assistant's messages since the month began, and conversations of the last days."""
    sources = table(s, d, "supplier").select(F.col("s_nationkey").alias("workspace"))
    return analytics.workspace_counts(view(s, d, "workspaces"), sources, view(s, d, "messages"), view(s, d, "conversations"), SINCE_MS, 2)
