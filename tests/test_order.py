"""What depends on order: seats, billing events; and components of long chains."""

import random

from quillspark.operators import billing, tenancy
from quillspark.operators.components import connected_components

ATTEMPT = "invitation string, user string, workspace string, email string, expires_ms long, role string, seq int"


def accept(spark, attempts, limit, members=("o",), workspaces=(("w1", "a"), ("w2", "a")), invites=True):
    people = sorted({a[1] for a in attempts} | set(members))
    users = spark.createDataFrame([(u, f"{u}@x.org") for u in people], "user string, email string")
    memberships = spark.createDataFrame([("w1", m, "owner") for m in members], "workspace string, user string, role string")
    limits = spark.createDataFrame([("a", limit, invites)], "account string, max_members int, invites boolean")
    rows = [(i, u, w, f"{u.upper()}@x.org", 100, "agent", seq) for seq, (i, u, w) in enumerate(attempts)]
    found = tenancy.accept_invitations(spark.createDataFrame(rows, ATTEMPT), users, memberships, spark.createDataFrame(list(workspaces), "workspace string, account string"), limits, 50)
    return [r["result"] for r in found.orderBy("seq").collect()]


def plain_accept(attempts, limit, members=("o",)):
    seated, inside, used, out = set(members), {("w1", m) for m in members}, set(), []
    for invitation, user, workspace in attempts:
        if invitation in used:
            out.append("not found")
            continue
        if (workspace, user) in inside:
            out.append("already a member")
        elif user not in seated and len(seated) >= limit:
            out.append("team is full")
            continue
        else:
            out.append("joined")
            seated.add(user)
            inside.add((workspace, user))
        used.add(invitation)
    return out


def test_two_acceptances_of_one_last_seat(spark):
    assert accept(spark, [("i1", "u1", "w1"), ("i2", "u2", "w1")], 2) == ["joined", "team is full"]
    assert accept(spark, [("i1", "u1", "w1"), ("i2", "u1", "w2"), ("i3", "u2", "w1"), ("i1", "u1", "w1"), ("i4", "u1", "w2")], 2) == ["joined", "joined", "team is full", "not found", "already a member"]
    assert accept(spark, [("i1", "u1", "w1")], 1) == ["team is full"]
    assert accept(spark, [("i1", "o", "w2"), ("i2", "o", "w1")], 1) == ["joined", "already a member"]
    assert accept(spark, [("i1", "u1", "w1")], 9, invites=False) == ["not on this plan"]


def test_random_acceptances(spark):
    rng = random.Random(1)
    for limit in (1, 4, 9):
        attempts = [(f"i{rng.randint(0, 30)}", f"u{rng.randint(0, 12)}", f"w{rng.randint(1, 2)}") for _ in range(60)]
        attempts = [(f"{i}-{u}-{w}", u, w) for i, u, w in attempts]
        assert accept(spark, attempts, limit) == plain_accept(attempts, limit)


def billed(spark, events, accounts=(("a1", "", ""), ("a2", "", ""))):
    kind = "event_id string, seq int, type string, object_id string, status string, account_id string, customer_id string, subscription_id string, price_id string, period_end long, cancel_at_period_end boolean"
    held = spark.createDataFrame([(a, "free", c, s) for a, c, s in accounts], "account string, plan string, stripe_customer_id string, stripe_subscription_id string")
    prices = spark.createDataFrame([("p", "pro")], "price_id string, price_plan string")
    after, told = billing.apply_events(held, spark.createDataFrame(events, kind), prices)
    return {r["account"]: (r["plan"], r["stripe_customer_id"], r["stripe_subscription_id"]) for r in after.collect()}, sorted(((r["event_id"], r["result"]) for r in told.collect()), key=repr)


def event(i, seq, kind, obj="", account="", customer="", sub="", status="active"):
    return (i, seq, kind, obj, status, account, customer, sub, "p", 0, False)


CHECKOUT, UPDATED, DELETED = "checkout.session.completed", "customer.subscription.updated", "customer.subscription.deleted"


def test_events_without_id_or_order_are_told_and_change_nothing(spark):
    events = [event("e1", 1, CHECKOUT, account="a1", customer="c1", sub="s1"), event("e2", None, UPDATED, obj="s1"), event(None, 3, UPDATED, obj="s1"), event(None, 4, UPDATED, obj="s1"), event("", None, "x")]
    accounts, told = billed(spark, events)
    assert accounts == {"a1": ("free", "c1", "s1"), "a2": ("free", "", "")}
    assert told == sorted([("e1", "linked stripe customer to account a1"), ("e2", "rejected: no place in the order"), (None, "rejected: no event id"), (None, "rejected: no event id"), ("", "rejected: no event id")], key=repr)


def test_accounts_are_found_as_they_stand(spark):
    """A subscription that moves on is looked for where it is now; of several accounts of a customer the first by name."""
    events = [event("e1", 1, CHECKOUT, account="a2", customer="c", sub="s"), event("e2", 2, CHECKOUT, account="a1", customer="c", sub="s9"), event("e3", 3, UPDATED, obj="s", customer="c"), event("e4", 4, DELETED, obj="s", customer="c"), event("e5", 5, UPDATED, obj="s", customer="c"), event("e1", 6, CHECKOUT, account="a1", customer="zz")]
    accounts, told = billed(spark, events)
    assert dict(told) == {"e1": "linked stripe customer to account a2", "e2": "linked stripe customer to account a1", "e3": "plan=pro status=active", "e4": "downgraded to free", "e5": "plan=pro status=active"}
    assert accounts == {"a1": ("pro", "c", "s"), "a2": ("free", "c", "")}


def test_a_long_chain_settles_in_few_rounds(spark):
    n = 10_000
    order = list(range(n))
    random.Random(2).shuffle(order)
    names = [f"n{i:05}" for i in order]
    edges = spark.createDataFrame(list(zip(names, names[1:], strict=False)) + [("x", "x"), ("y", None), ("z1", "z2")], "u string, v string")
    found = {r["node"]: r["root"] for r in connected_components(edges, most_rounds=19).collect()}
    assert found == dict.fromkeys(names, "n00000") | {"z1": "z1", "z2": "z1"}
    assert connected_components(edges.limit(0)).count() == 0
