"""Keyed state: upserts, validity changes and what they make stale, code mappings, quotas, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Codes and the day from which the new ones apply.
CUTOVER = "2024-07-01"
CODE_ALIASES = [
    ("bharatiya nagarik suraksha sanhita", "BNSS"), ("bharatiya sakshya adhiniyam", "BSA"), ("code of criminal procedure", "CrPC"), ("bharatiya nyaya sanhita", "BNS"),
    ("indian evidence act", "Indian Evidence Act"), ("indian penal code", "IPC"), ("evidence act", "Indian Evidence Act"), ("crpc", "CrPC"), ("bnss", "BNSS"), ("ipc", "IPC"), ("bns", "BNS"), ("bsa", "BSA"), ("iea", "Indian Evidence Act"),
]
#: Plan, price a month in minor units, queries a day (None: no limit), workspaces, most active workspaces, seats.
PLANS = [
    ("FREE", 0, 20, False, None, 1),
    ("ADVOCATE_PRO", 79900, None, True, 5, 1),
    ("CHAMBER_PRO", 249900, None, True, 25, 5),
]
ACTIVE = ["ACTIVE"]


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of changes in place of those with their keys."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def needs_reembedding(embedded: Column, model: Column, version: Column, target_model: str, target_version: str) -> Column:
    return embedded & ~(model.eqNullSafe(F.lit(target_model)) & version.eqNullSafe(F.lit(target_version)))


def judgment_updates(documents: DataFrame, updates: DataFrame, edges: DataFrame) -> DataFrame:
    """documents with new validity, overruling authority and what is stale: the targets and all that cite them, one hop.

    updates: target, new_validity, authority, authority_date; the last by (authority_date, authority) holds.
    """
    u = latest(updates, ["target"], [F.desc("authority_date"), F.desc("authority")])
    u = u.select(F.col("target").alias("doc_id"), "new_validity", "authority", "authority_date")
    citing = edges.join(u.select(F.col("doc_id").alias("target")), "target", "left_semi").select(F.col("source").alias("doc_id"), F.lit(True).alias("cites")).distinct()
    d = documents.join(u, "doc_id", "left").join(citing, "doc_id", "left")
    reason = F.when(F.col("new_validity").isNotNull(), "validity_changed").when(F.col("cites"), "cites_changed_authority")
    return d.select(
        "doc_id", F.coalesce("new_validity", "current_validity").alias("current_validity"), F.col("authority").alias("overruled_by"),
        F.col("authority_date").alias("overruled_date"), reason.isNotNull().alias("stale"), reason.alias("stale_reason"),
    )


def statute_updates(sections: DataFrame, updates: DataFrame) -> DataFrame:
    """Sections after updates (statute_id, section, new_text, in_force): changed text is amended and needs embedding anew, a section out of force is repealed and stale only."""
    s = sections.join(updates, ["statute_id", "section"], "left")
    changed = F.col("new_text").isNotNull() & ~F.col("new_text").eqNullSafe(F.col("text"))
    gone = F.col("new_in_force") == F.lit(False)
    return s.select(
        "statute_id", "section", F.when(changed, F.col("new_text")).otherwise(F.col("text")).alias("text"), F.coalesce("new_in_force", "in_force").alias("in_force"),
        F.when(gone, "REPEALED").when(changed, "AMENDED").otherwise("GOOD_LAW").alias("validity"), F.coalesce(changed | gone, F.lit(False)).alias("stale"), F.coalesce(changed & ~F.coalesce(gone, F.lit(False)), F.lit(False)).alias("reembed"),
    )


def code_reference(reference: Column) -> Column:
    """(code, section) of a reference such as `Section 302 IPC`; null if it names no code."""
    r = F.trim(F.regexp_replace(F.regexp_replace(reference, r"(?i)\bsection\b", " "), r"\s+", " "))
    low = F.lower(r)
    code, section = F.lit(None).cast("string"), F.lit(None).cast("string")
    for alias, name in reversed(CODE_ALIASES):
        lead, tail = low.startswith(alias + " "), low.endswith(" " + alias)
        code = F.when(lead | tail, name).otherwise(code)
        n = F.char_length(r)
        section = F.when(lead, F.upper(F.trim(F.substr(r, F.lit(len(alias) + 2), n)))).when(tail, F.upper(F.trim(F.substr(r, F.lit(1), n - len(alias) - 1)))).otherwise(section)
    return F.when(code.isNotNull(), F.struct(code.alias("code"), section.alias("section")))


def mapped_references(references: DataFrame, mappings: DataFrame) -> DataFrame:
    """(reference, reference_date) with the preferred and the equivalent reference on that day.

    mappings: legacy_code, legacy_section, new_code, new_section, is_active. On and after the cutover the new code is preferred.
    """
    r = references.withColumn("ref", code_reference(F.col("reference")))
    r = r.withColumn("code", F.col("ref.code")).withColumn("section", F.col("ref.section")).drop("ref")
    m = mappings.where("is_active")
    old = latest(m, ["legacy_code", "legacy_section"], [F.asc("new_code"), F.asc("new_section")]).select(F.col("legacy_code").alias("code"), F.col("legacy_section").alias("section"), F.struct("legacy_code", "legacy_section", "new_code", "new_section").alias("by_old"))
    new = latest(m, ["new_code", "new_section"], [F.asc("legacy_code"), F.asc("legacy_section")]).select(F.col("new_code").alias("code"), F.col("new_section").alias("section"), F.struct("legacy_code", "legacy_section", "new_code", "new_section").alias("by_new"))
    r = r.join(old, ["code", "section"], "left").join(new, ["code", "section"], "left").withColumn("m", F.coalesce("by_old", "by_new"))
    post = F.coalesce(F.col("reference_date"), F.to_date(F.lit(CUTOVER))) >= F.to_date(F.lit(CUTOVER))
    own = F.concat_ws(" ", "code", "section")
    legacy, fresh = F.concat_ws(" ", "m.legacy_code", "m.legacy_section"), F.concat_ws(" ", "m.new_code", "m.new_section")
    preferred = F.when(F.col("m").isNull(), own).when(post, fresh).otherwise(legacy)
    equivalent = F.when(F.col("m").isNotNull(), F.when(post, legacy).otherwise(fresh))
    return r.select("reference", "reference_date", "code", "section", preferred.alias("preferred"), equivalent.alias("equivalent"), F.col("m").isNotNull().alias("mapped"))


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))


def plan_value(plan: Column, at: int, kind: str) -> Column:
    """A plan's entry; that of FREE for null and unknown plans."""
    out = F.lit(PLANS[0][at]).cast(kind)
    for row in PLANS[1:]:
        out = F.when(plan == row[0], F.lit(row[at]).cast(kind)).otherwise(out)
    return out


def subscriptions_resolved(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """users (user_id, ..) with plan, status, price_minor, daily_limit (null: none), workspace_access, max_workspaces, seats by their subscription (user_id, plan, status); FREE without one."""
    u = users.join(subscriptions.select("user_id", "plan", "status"), "user_id", "left")
    u = u.withColumn("plan", F.coalesce("plan", F.lit("FREE"))).withColumn("status", F.coalesce("status", F.lit("FREE")))
    paid = plan_value(F.col("plan"), 3, "boolean") & F.col("status").isin(*ACTIVE)
    return u.withColumns({"price_minor": plan_value(F.col("plan"), 1, "long"), "daily_limit": plan_value(F.col("plan"), 2, "long"), "workspace_access": paid, "max_workspaces": plan_value(F.col("plan"), 4, "long"), "seats": plan_value(F.col("plan"), 5, "long")})


def allowance(requests: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Whether a request is let through: requests (user_id, day, used, workspace_id) with plan, daily_limit, remaining, allowed, code.

    Requests without a user are previews and always pass; a workspace needs an active paid plan; only plans with a daily limit run out.
    """
    r = subscriptions_resolved(requests, subscriptions)
    anonymous = F.col("user_id").isNull()
    locked = F.col("workspace_id").isNotNull() & ~F.col("workspace_access")
    spent = F.coalesce(F.col("used") >= F.col("daily_limit"), F.lit(False))
    code = F.when(anonymous, F.lit(None)).when(locked, "plan_upgrade_required").when(spent, "free_tier_limit_reached")
    remaining = F.when(F.col("daily_limit").isNotNull(), F.greatest(F.col("daily_limit") - F.col("used"), F.lit(0)))
    return r.select("user_id", "day", "used", "plan", "daily_limit", remaining.alias("remaining"), code.isNull().alias("allowed"), code.alias("code"))


def checkouts(requests: DataFrame) -> DataFrame:
    """Subscriptions that requests (user_id, plan, requested_at) open: pending, with the plan's seats and limits. FREE opens none. The id follows from user, plan and time."""
    r = requests.where("plan <> 'FREE'")
    key = F.substr(F.sha1(F.concat_ws("|", "user_id", "plan", F.col("requested_at").cast("string"))), F.lit(1), F.lit(12))
    return r.select(
        "user_id", "plan", F.lit("CHECKOUT_PENDING").alias("status"), F.concat(F.lit("rzp_sub_preview_"), key).alias("provider_subscription_id"), plan_value(F.col("plan"), 5, "long").alias("seats"),
        plan_value(F.col("plan"), 2, "long").alias("daily_limit"), plan_value(F.col("plan"), 4, "long").alias("max_workspaces"), F.col("requested_at").alias("created_at"),
    )


def invoices(charges: DataFrame) -> DataFrame:
    """charges (user_id, amount_minor, status, description, issued_at) as invoices: in rupees, paid when issued if their status is PAID."""
    return charges.select("user_id", "amount_minor", F.lit("INR").alias("currency"), "status", "issued_at", F.when(F.col("status") == "PAID", F.col("issued_at")).alias("paid_at"), "description")


def amendments_merged(amendments: DataFrame, updates: DataFrame) -> DataFrame:
    """Amendments by (statute_id, section, amending_act, amended_on): an update's new text, summary and effective date in place of the old row's, or a new row."""
    keys = ["statute_id", "section", "amending_act", "amended_on"]
    last = latest(updates, keys, [F.desc("effective_on"), F.desc("new_text")])
    old, new = amendments.alias("o"), last.alias("n")
    both = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return both.select(*[pick(c) for c in [*keys, "previous_text", "new_text", "effective_on"]])


def mappings_upserted(mappings: DataFrame, changes: DataFrame) -> DataFrame:
    """Code mappings with changes in place of rows of the same legacy code and section and new code and section; references are canonical, and a mapping needs both ends."""
    keys = ["legacy_code", "legacy_section", "new_code", "new_section"]
    tidy = lambda c: F.upper(F.trim(c))
    c = changes.withColumn("legacy_section", tidy("legacy_section")).withColumn("new_section", tidy("new_section")).dropna(subset=keys)
    return upserted(mappings, c.dropDuplicates(keys), keys)


def references_expanded(references: DataFrame, mappings: DataFrame) -> DataFrame:
    """Per query (query_id, position, reference, reference_date) the references to search for: each one's preferred form, then its equivalent, once, in order."""
    m = mapped_references(references.select("reference", "reference_date").distinct(), mappings).withColumnsRenamed({"reference": "own", "reference_date": "day"})
    r = references.join(m, F.col("reference").eqNullSafe(F.col("own")) & F.col("reference_date").eqNullSafe(F.col("day")), "left").select("query_id", "position", "reference", "code", "preferred", "equivalent")
    each = F.filter(F.array(F.when(F.col("code").isNull(), F.trim("reference")).otherwise(F.col("preferred")), F.col("equivalent")), lambda x: x.isNotNull())
    forms = r.select("query_id", "position", F.posexplode(each).alias("turn", "form"))
    first = forms.groupBy("query_id", "form").agg(F.min(F.struct("position", "turn")).alias("at"))
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "form"))), lambda x: x["form"]).alias("references"))
