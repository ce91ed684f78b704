"""Billing: an idempotent ledger of events, folded into account state."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.components import connected_components
from quillspark.sources.shared import materialize

EVENT = "struct<id: string, type: string, created: bigint, data: struct<object: struct<id: string, status: string, cancel_at_period_end: boolean, metadata: map<string, string>, customer: string, subscription: string, items: struct<data: array<struct<price: struct<id: string>, current_period_end: bigint>>>>>>"
PAID = ("active", "trialing", "past_due")


def parse_events(raw: DataFrame, body_col: str = "body") -> DataFrame:
    """Fields of webhook bodies that the fold reads; extra columns are kept.

    A customer or subscription is an object with an id, or the id itself.
    """
    plain = lambda c: F.coalesce(F.get_json_object(c, "$.id"), c, F.lit(""))
    e = raw.withColumn("__e", F.from_json(body_col, EVENT))
    o, item = "__e.data.object", F.get(F.col("__e.data.object.items.data"), F.lit(0))
    return e.select(
        *raw.columns, F.col("__e.id").alias("event_id"), F.col("__e.type").alias("type"), F.col(f"{o}.id").alias("object_id"), F.col(f"{o}.status").alias("status"),
        F.coalesce(f"{o}.cancel_at_period_end", F.lit(False)).alias("cancel_at_period_end"), F.col(f"{o}.metadata")["account_id"].alias("account_id"),
        plain(F.col(f"{o}.customer")).alias("customer_id"), plain(F.col(f"{o}.subscription")).alias("subscription_id"),
        F.coalesce(item["price"]["id"], F.lit("")).alias("price_id"), item["current_period_end"].alias("period_end"),
    )


# Fixed value: seconds by which a signature may be older than its delivery.
TOLERANCE = 300


def signature_valid(body: Column, header: Column, secret: str, now: int | None = None, received: Column | None = None) -> Column:
    """Whether any ``v1`` of a ``t=…,v1=…`` header signs the raw body, at most five minutes before it was received.

    That time is ``received`` or ``now``, in epoch seconds; without either, the age
    isn't looked at.  Without a secret nothing is valid.
    """

    @F.pandas_udf(T.BooleanType())
    def check(bodies: pd.Series, headers: pd.Series, times: pd.Series) -> pd.Series:
        def one(b: str | None, h: str | None, time: float) -> bool:
            parts = [x.strip().split("=", 1) for x in (h or "").split(",") if "=" in x]
            at = dict(parts).get("t", "")
            if not secret or not at.isdigit() or time - int(at) > TOLERANCE:  # no time: not a number, so never too old
                return False
            made = hmac.new(secret.encode(), f"{at}.{b or ''}".encode(), hashlib.sha256).hexdigest()
            return any(k == "v1" and hmac.compare_digest(made.encode(), v.encode()) for k, v in parts)

        return pd.Series([one(b, h, t) for b, h, t in zip(bodies, headers, times.astype("float64"), strict=True)], dtype=bool)

    return check(body, header, F.lit(now).cast("double") if received is None else received.cast("double"))


def ledger(events: DataFrame, order_col: str = "seq") -> DataFrame:
    """Each event id once, as first delivered."""
    first = Window.partitionBy("event_id").orderBy(order_col)
    return events.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def priced(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows with the plan of their ``price_id``, null where ``prices(price_id, price_plan)`` has none."""
    return rows.join(prices, "price_id", "left")


def unmapped(price: Column) -> Column:
    """What the ledger says of a price without a plan."""
    return F.concat(F.lit("unmapped price "), F.coalesce(price, F.lit("")))


#: Fields of an account that events set.
FIELDS = ("plan", "subscription_status", "stripe_customer_id", "stripe_subscription_id", "stripe_price_id", "cancel_at_period_end", "current_period_end")
# Types of events that are applied.
CHECKOUT, FAILED, DELETED, SUBSCRIPTION = "checkout.session.completed", "invoice.payment_failed", "customer.subscription.deleted", "customer.subscription."


class _Accounts(dict):
    """Accounts of a group by name, found by customer or subscription, too: the first by name of several."""

    def __init__(self) -> None:
        self.by: dict[str, dict[str, set[str]]] = {"stripe_customer_id": {}, "stripe_subscription_id": {}}

    def set(self, name: str, **fields: object) -> None:
        account = self.setdefault(name, {})
        for field, names in self.by.items():
            if field in fields:
                names.get(account.get(field), set()).discard(name)
                names.setdefault(fields[field], set()).add(name)
        account.update(fields)

    def find(self, field: str, value: str) -> str | None:
        return min(self.by[field].get(value, ()), default=None) if value else None


def _result(event: dict, accounts: _Accounts) -> str:
    """Apply one event to the accounts of its group, and say what was done."""
    # The sentences that the ledger keeps.
    kind, sub, customer = event["type"], event["object_id"], event["customer_id"]
    if kind == CHECKOUT:
        name = event["account_id"]
        if not name:
            return "no account_id in metadata"
        if name not in accounts:
            return f"unknown account {name}"
        given = {"stripe_customer_id": customer, "stripe_subscription_id": event["subscription_id"]}
        accounts.set(name, **{field: value for field, value in given.items() if value})
        return f"linked stripe customer to account {name}"
    if kind == FAILED:
        if not customer:
            return "invoice without a customer"
        name = accounts.find("stripe_customer_id", customer)
        if name is None:
            return f"no account for customer {customer}"
        accounts.set(name, subscription_status="past_due")
        return "payment failed; plan unchanged pending Stripe retries"
    if kind not in (DELETED, f"{SUBSCRIPTION}created", f"{SUBSCRIPTION}updated"):
        return "ignored"
    name = accounts.find("stripe_subscription_id", sub) or accounts.find("stripe_customer_id", customer)
    if name is None:
        return f"no account for subscription {sub}"
    if kind == DELETED:
        accounts.set(name, plan="free", subscription_status="canceled", stripe_subscription_id="", stripe_price_id="", cancel_at_period_end=False)
        return "downgraded to free"
    if event["price_plan"] is None:
        return f"unmapped price {event['price_id']}"
    plan = event["price_plan"] if event["status"] in PAID else "free"
    accounts.set(name, plan=plan, subscription_status=event["status"], stripe_subscription_id=sub, stripe_price_id=event["price_id"], cancel_at_period_end=bool(event["ending"]))
    if (event["period_end"] or 0) > 0:
        accounts.set(name, current_period_end=datetime.fromtimestamp(event["period_end"], UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    return f"plan={plan} status={event['status']}"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk groups in order, accounts before events; only the accounts of the group at hand are held."""
    now, accounts = None, _Accounts()
    row = lambda **x: dict.fromkeys(OUT.names) | x
    told = lambda: [row(kind=OF_ACCOUNT, account=k, **v) for k, v in accounts.items()]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["group"] != now:
                out += told()
                now, accounts = r["group"], _Accounts()
            if r["kind"] == OF_ACCOUNT:
                accounts.set(r["account"], **{f: r[f] for f in FIELDS})
            else:
                out.append(row(kind=OF_EVENT, event_id=r["event_id"], type=r["type"], result=_result(r, accounts)))
        yield pa.RecordBatch.from_pylist(out, schema=OUT)
    yield pa.RecordBatch.from_pylist(told(), schema=OUT)


#: What a row of the fold is.
OF_ACCOUNT, OF_EVENT = 0, 1
OUT = pa.schema([("kind", pa.int32()), *((c, pa.bool_() if c == "cancel_at_period_end" else pa.string()) for c in ("account", *FIELDS, "event_id", "type", "result"))])


def apply_events(accounts: DataFrame, events: DataFrame, prices: DataFrame, order_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """``(accounts after all events, ledger rows with their result)``.

    Each event id counts once, in order of first delivery.  Checkouts find their
    account by metadata; subscription events by the subscription id that an account
    has at that time, else by its customer id; failed payments by customer id.  So
    the state is folded in order, within groups of accounts, customers and
    subscriptions that events or accounts link: a group is walked as a stream in
    one task, by its meaning, and groups spread over the cluster.

    Events without an id or without a place in the order can't be told apart or
    applied; each of them is a ledger row that says so, and changes nothing.
    """
    placed, known = F.col(order_col).isNotNull(), F.coalesce(F.col("event_id").cast("string"), F.lit("")) != ""
    said = F.when(~known, "rejected: no event id").otherwise("rejected: no place in the order")
    rejected = events.where(~(known & placed)).select(F.col("event_id").cast("string").alias("event_id"), F.col("type").cast("string").alias("type"), said.alias("result"))
    rows = priced(ledger(events.where(known & placed), order_col), prices)
    wanted = {"period_end": "bigint", "cancel_at_period_end": "boolean"}
    for c in ("event_id", "type", "object_id", "status", "account_id", "customer_id", "subscription_id", "price_id", *wanted):
        given = F.col(c) if c in rows.columns else F.lit(None)
        rows = rows.withColumn(c, given.cast(wanted.get(c, "string")))
    for c in FIELDS:
        if c not in accounts.columns:
            accounts = accounts.withColumn(c, F.lit(False if c == "cancel_at_period_end" else ""))
    named = lambda kind, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{kind}:"), c))
    subscribed = F.col("type").startswith(SUBSCRIPTION)
    own = [named("a", F.when(F.col("type") == CHECKOUT, F.col("account_id"))), named("c", F.col("customer_id")), named("s", F.when(subscribed, F.col("object_id")).otherwise(F.col("subscription_id")))]
    rows = rows.withColumn("ids", F.array_compact(F.array(*own, named("e", F.col("event_id")))))
    held = accounts.withColumn("ids", F.array_compact(F.array(named("a", F.col("account")), named("c", F.col("stripe_customer_id")), named("s", F.col("stripe_subscription_id")))))
    links = lambda df: df.select(F.get("ids", F.lit(0)).alias("u"), F.explode("ids").alias("v"))
    groups = connected_components(links(rows).unionByName(links(held)))
    first = F.get("ids", F.lit(0))
    grouped = lambda df: df.withColumn("node", first).join(groups, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("node", "root", "ids")
    state = grouped(held).select("group", F.lit(OF_ACCOUNT).alias("kind"), "account", *FIELDS)
    events_in = grouped(rows.withColumn("seq", F.col(order_col).cast("bigint")).withColumnRenamed("cancel_at_period_end", "ending"))
    events_in = events_in.select("group", F.lit(OF_EVENT).alias("kind"), "seq", "event_id", "type", "object_id", "status", "account_id", "customer_id", "subscription_id", "price_id", "price_plan", "period_end", "ending")
    both = state.unionByName(events_in, allowMissingColumns=True)
    ordered = both.repartition("group").sortWithinPartitions("group", "kind", "seq", "account")
    kind = ", ".join(f"{f.name} { {'kind': 'int', 'cancel_at_period_end': 'boolean'}.get(f.name, 'string')}" for f in OUT)
    done = materialize(ordered.mapInArrow(_folded, kind), "billing")
    told = done.where(F.col("kind") == OF_EVENT).select("event_id", "type", "result")
    return done.where(F.col("kind") == OF_ACCOUNT).select(*accounts.columns), told.unionByName(rejected)
