"""Users and their settings: an append-only settings log is the storage, the
current state is derived (latest row per user), never updated in place.

* W4 ``latest_settings``: latest row per user as a *aggregate* (max of a
  struct led by ``(updated_at, seq)``), which combines map-side, so a user
  with a huge history does not pile up in one window partition
* F7 ``subscribed_users``, J2 ``semi_subscribed``
* J3 ``subscribe_actions``: insert / resubscribe / none
* J4 ``settings_or_default``: own settings if registered, else the default
* F10 ``flags_to_categories`` / ``settings_unpivot``
* J9 ``letter_match`` + W5, F11 ``settings_apply``
* J10 ``asof_digest``: the last digest a user got before a request
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import CATEGORIES, CATEGORY_NAMES
from ..functions.requests import classify_request, parse_settings
from ..session import broadcast_if_small, checkpoint

SETTINGS_VALUES = ["is_subscribed", "news_amount", *CATEGORY_NAMES]


def latest_settings(log: DataFrame) -> DataFrame:
    """(user_id, updated_at, seq, is_subscribed, news_amount, flags...)."""
    latest = F.max(F.struct("updated_at", "seq", *SETTINGS_VALUES)).alias("s")
    return log.groupBy("user_id").agg(latest).select("user_id", "s.*")


def flags_to_categories(flag_cols: list[str] | None = None) -> Column:
    """array of the categories whose flag is set, in column order."""
    flag_cols = flag_cols or CATEGORY_NAMES
    return F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in flag_cols]))


def settings_unpivot(settings: DataFrame) -> DataFrame:
    """F10 long form: (user_id, seq, ordinal, category) for every set flag."""
    long = settings.unpivot(["user_id", "seq"], CATEGORY_NAMES, "category", "flag")
    ordinal = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_NAMES]), F.col("category"))
    return (long.where(F.col("flag"))
            .select("user_id", "seq", ordinal.cast("int").alias("ordinal"), "category"))


def subscribed_users(log: DataFrame) -> DataFrame:
    """current settings of users whose current flag is on."""
    return latest_settings(log).where(F.col("is_subscribed"))


def semi_subscribed(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests of subscribed users only."""
    return requests.join(subscribed_users(log).select("user_id"), "user_id", "left_semi")


def subscribe_actions(commands: DataFrame, log: DataFrame) -> DataFrame:
    """Per subscribe command: ``insert`` (never seen: new user + default
    settings), ``resubscribe`` (known, flag off) or ``none``."""
    cur = latest_settings(log).select("user_id", "is_subscribed")
    j = commands.join(cur, "user_id", "left")
    action = (F.when(F.col("is_subscribed").isNull(), F.lit("insert"))
              .when(~F.col("is_subscribed"), F.lit("resubscribe"))
              .otherwise(F.lit("none")))
    return j.withColumn("action", action).drop("is_subscribed")


def settings_or_default(people: DataFrame, registered: DataFrame, log: DataFrame,
                        default: DataFrame) -> DataFrame:
    """(user_id, source, is_subscribed, news_amount, categories) for every
    id in ``people``: own latest settings when registered and present, else
    the one-row default (broadcast, its size is one row)."""
    cur = latest_settings(log).join(registered.select("user_id"), "user_id", "left_semi")
    d = default.select(*[F.col(c).alias(f"d_{c}") for c in SETTINGS_VALUES])
    j = people.select("user_id").join(cur, "user_id", "left")
    j = _with_default(j, d)
    own = F.col("updated_at").isNotNull()
    cols = {c: F.when(own, F.col(c)).otherwise(F.col(f"d_{c}")) for c in SETTINGS_VALUES}
    out = j.select("user_id", F.when(own, "own").otherwise("default").alias("source"),
                   *[v.alias(k) for k, v in cols.items()])
    return out.withColumn("categories", flags_to_categories()).drop(*CATEGORY_NAMES)


def _with_default(df: DataFrame, default_prefixed: DataFrame) -> DataFrame:
    """Attach the one-row default as literal columns (read once; one row)."""
    row = default_prefixed.first()
    return df.withColumns({k: F.lit(v) for k, v in row.asDict().items()})


def user_events(commands: DataFrame, log: DataFrame, default: DataFrame) -> DataFrame:
    """J3 with effect: subscribe and unsubscribe commands (request_id, user_id,
    sent_at, command) -> the settings rows to append, with their ``action``:
    ``insert`` (never seen: default settings, flag on), ``resubscribe`` (flag
    on again), ``unsubscribe`` (flag off). A command that changes nothing
    yields no row.

    The state before a command is that of the user's command before it, or the
    log's latest row for the first one."""
    cur = latest_settings(log)
    j = commands.join(cur.select("user_id", *SETTINGS_VALUES, F.lit(True).alias("_known")), "user_id", "left")
    w = Window.partitionBy("user_id").orderBy("sent_at", "request_id")
    before = F.lag("command").over(w)
    seen = F.max((F.col("command") == "subscribe").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    on = F.when(before.isNotNull(), before == "subscribe").otherwise(F.coalesce("is_subscribed", F.lit(False)))
    j = (j.withColumn("_on", on).withColumn("_seen", F.coalesce("_known", F.lit(False)) | (F.coalesce(seen, F.lit(0)) == 1)))
    sub = F.col("command") == "subscribe"
    action = (F.when(sub & ~F.col("_seen"), "insert").when(sub & ~F.col("_on"), "resubscribe")
              .when(~sub & F.col("_on") & F.col("_seen"), "unsubscribe"))
    j = j.withColumn("action", action).where(F.col("action").isNotNull())
    j = _with_default(j, default.select(*[F.col(c).alias(f"d_{c}") for c in SETTINGS_VALUES]))
    own = F.coalesce("_known", F.lit(False))
    values = {c: F.when(own, F.col(c)).otherwise(F.col(f"d_{c}")) for c in SETTINGS_VALUES if c != "is_subscribed"}
    return j.select("action", "user_id", F.col("sent_at").alias("updated_at"), F.col("request_id").alias("seq"),
                    (F.col("command") == "subscribe").alias("is_subscribed"), *[v.alias(k) for k, v in values.items()])


def letter_match(letters: DataFrame, categories: DataFrame) -> DataFrame:
    """J9 + W5: each (request_id, pos, letter) -> the first category (by
    ordinal) whose title starts with the letter; NULL when none does.
    Single letters make it an equi-join on the first letter of the title."""
    cats = categories.select(F.lower(F.substring("title", 1, 1)).alias("letter"), "ordinal", "category")
    first = cats.groupBy("letter").agg(F.min_by("category", "ordinal").alias("category"))
    return letters.join(F.broadcast(first), "letter", "left")


def settings_apply(requests: DataFrame, log: DataFrame, categories: DataFrame) -> DataFrame:
    """F11 (+J2, J9): settings requests of subscribed users -> new settings
    rows (all flags reset, chosen ones set, amount replaced). A request with
    an unknown letter is invalid and yields no row."""
    letters_col, amount_col = parse_settings("text")
    req = (requests.where(classify_request("text") == "settings")
           .select("request_id", "user_id", "sent_at",
                   letters_col.alias("letters"), amount_col.alias("news_amount")))
    req = req.join(subscribed_users(log).select("user_id"), "user_id", "left_semi")
    chars = req.select("request_id", F.posexplode(F.split("letters", "")).alias("pos", "letter"))
    matched = letter_match(chars, categories)
    chosen = (matched.groupBy("request_id")
              .agg(F.count("*").alias("n_letters"), F.count("category").alias("n_matched"),
                   F.collect_set("category").alias("chosen"))
              .where(F.col("n_letters") == F.col("n_matched")))
    j = req.join(chosen, "request_id")
    flags = {c: F.array_contains("chosen", c) for c in CATEGORY_NAMES}
    return j.select("request_id", "user_id", F.col("sent_at").alias("updated_at"),
                    F.col("request_id").alias("seq"), F.lit(True).alias("is_subscribed"),
                    "news_amount", *[v.alias(k) for k, v in flags.items()])


def asof_digest(requests: DataFrame, digests: DataFrame) -> DataFrame:
    """For each request (request_id, user_id, sent_at) the last digest
    (digest_sent_at, digest_date, part) with ``digest.sent_at <= sent_at``.

    Two levels so that a very active user is not one window partition: the
    running latest digest is computed per (user, hour); the carry from earlier
    hours comes from a per-(user, hour) summary whose size is bounded by the
    number of hours in the time range, not by the number of events. Digests of
    users without a request are left out first; requests, their users and the
    digests left are written, so that sizes are seen and each is made once."""
    requests = checkpoint(requests.select("request_id", "user_id", "sent_at"), "asof-requests")
    asked = checkpoint(requests.select("user_id").distinct(), "asof-users")
    digests = checkpoint(digests.join(broadcast_if_small(asked), "user_id", "left_semi")
                         .select("user_id", "sent_at", "digest_date", "part"), "asof-digests")
    bucket = F.date_trunc("hour", F.col("sent_at"))
    dig = F.struct(F.col("sent_at").alias("at"), "digest_date", F.col("part").cast("int").alias("part"))
    r = requests.select("request_id", "user_id", "sent_at",
                        F.lit(None).cast(dig_type()).alias("_dig"), F.lit(1).alias("_kind"))
    g = digests.select(F.lit(None).cast("long").alias("request_id"), "user_id", "sent_at",
                       dig.alias("_dig"), F.lit(0).alias("_kind"))
    u = r.unionByName(g).withColumn("_bucket", bucket)
    w = (Window.partitionBy("user_id", "_bucket").orderBy("sent_at", "_kind")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = u.withColumn("_in_bucket", F.max("_dig").over(w))
    per_bucket = u.groupBy("user_id", "_bucket").agg(F.max("_dig").alias("_bucket_last"))
    wb = (Window.partitionBy("user_id").orderBy("_bucket")
          .rowsBetween(Window.unboundedPreceding, -1))
    carry = per_bucket.select("user_id", "_bucket", F.max("_bucket_last").over(wb).alias("_carry"))
    res = (u.where(F.col("_kind") == 1).join(carry, ["user_id", "_bucket"], "left")
           .withColumn("_hit", F.coalesce("_in_bucket", "_carry")))
    return res.select("request_id", "user_id", "sent_at",
                      F.col("_hit.at").alias("digest_sent_at"),
                      F.col("_hit.digest_date").alias("digest_date"),
                      F.col("_hit.part").alias("part"))


def dig_type() -> str:
    return "struct<at:timestamp_ntz,digest_date:date,part:int>"
