"""Request and change streams derived from the test click-stream (``events``).

The shop receives lookups, logins, sign-ups, status changes and deletions as
requests; the test data has none, so each request kind is a projection of the
whole ``events`` table (the event's ``user_id`` plays the id the request
names).  The SQL twins are the ``s_order_requests`` / ``s_status_changes``
CTEs of the oracle and the oracle bodies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which event types stand for which order status change.
STATUS_BY_EVENT = (("purchase", "paid"), ("signup", "draft"), ("click", "pending_approval"))


def order_requests(events: DataFrame) -> DataFrame:
    """Ids of the orders that were looked up: one row per distinct id."""
    return events.select(F.col("user_id").alias("order_id")).distinct()


def login_attempts(events: DataFrame) -> DataFrame:
    """Login keys: sign-ups and purchases log in with the e-mail, other
    events with the username (both lower-cased by ``find_login``)."""
    by_email = F.concat(F.lit("User"), F.col("user_id").cast("string"), F.lit("@Example.com"))
    by_name = F.format_string("Customer#%09d", F.col("user_id"))
    key = F.when(F.col("event_type").isin("signup", "purchase"), by_email).otherwise(by_name)
    return events.select(F.col("event_id"), key.alias("login"))


def status_changes(events: DataFrame) -> DataFrame:
    """Order status changes ``(event_id, ts, order_id, status)``."""
    status = None
    for ev, st in STATUS_BY_EVENT:
        status = (F.when if status is None else status.when)(F.col("event_type") == ev, F.lit(st))
    return events.where(F.col("event_type").isin([e for e, _ in STATUS_BY_EVENT])).select(
        "event_id", "ts", F.col("user_id").alias("order_id"), status.alias("status")
    )


def deletion_requests(events: DataFrame) -> DataFrame:
    """Order deletion requests: ids named by error events."""
    return events.where(F.col("event_type") == "error").select(F.col("user_id").alias("order_id"))


def newsletter_signups(events: DataFrame) -> DataFrame:
    """Newsletter sign-ups ``(event_id, ts, email)`` from sign-up events: the
    visitor's number times 20, so some addresses are subscribers' and others
    are new, and visitors sign up repeatedly."""
    return events.where(F.col("event_type") == "signup").select(
        "event_id",
        "ts",
        F.concat(F.lit("user"), (F.col("user_id") * 20).cast("string"), F.lit("@example.com")).alias("email"),
    )


def new_orders(events: DataFrame) -> DataFrame:
    """New orders placed by purchase events ``(event_id, ts, user_id, total)``."""
    return events.where(F.col("event_type") == "purchase").select(
        "event_id", "ts", "user_id", F.col("value").alias("total")
    )


def user_registrations(events: DataFrame) -> DataFrame:
    """User sign-ups ``(event_id, ts, username, email)``: the username names
    the signing-up visitor (repeats within the feed conflict), the e-mail is
    per event."""
    return events.where(F.col("event_type") == "signup").select(
        "event_id",
        "ts",
        F.concat(F.lit("Shopper"), F.col("user_id").cast("string")).alias("username"),
        F.concat(F.lit("New"), F.col("event_id").cast("string"), F.lit("@Example.com")).alias("email"),
    )


def shared_email_registrations(events: DataFrame) -> DataFrame:
    """User sign-ups in which both guards clash: usernames by visitor, and
    e-mails shared by visitors whose event values round alike."""
    return events.where(F.col("event_type") == "signup").select(
        "event_id",
        "ts",
        F.concat(F.lit("Shopper"), F.col("user_id").cast("string")).alias("username"),
        F.concat(F.lit("Mail"), F.floor("value").cast("string"), F.lit("@Example.com")).alias("email"),
    )


def numbered_orders(events: DataFrame) -> DataFrame:
    """New orders of which some bring their own number: used ones, repeated
    ones and free ones beyond the table's."""
    number = F.when(F.col("value") > 50, F.col("user_id") * 200)
    return new_orders(events).join(
        events.select("event_id", number.alias("order_id")), "event_id"
    )


def stock_requests(order_item: DataFrame) -> DataFrame:
    """Stock checks whose three ids come from different places: the line's
    own id, twice its order's number and its product's number moved by the
    quantity, so that orders and products are sometimes missing."""
    return order_item.select(
        "order_item_id", (F.col("order_id") * 2).alias("order_id"), (F.col("product_id") + F.col("quantity")).alias("product_id")
    )


def text_id_requests(events: DataFrame) -> DataFrame:
    """Stock checks as they come in request paths, ids as text: a number with
    something after it, blanks and a sign before it, no number at all, or one
    beyond 32 bits, by event type."""
    number = F.col("user_id").cast("string")
    kind = F.col("event_type")
    order = (
        F.when(kind == "click", F.concat(number, F.lit("abc"))).when(kind == "error", F.lit("abc"))
        .when(kind == "signup", F.concat(F.lit("  +"), number)).otherwise((F.col("user_id") + (1 << 33)).cast("string"))
    )
    product = F.when(F.col("value") > 90, F.lit("")).otherwise(F.concat(number, F.lit(".5")))
    line = F.concat(number, F.lit("-1"))
    return events.select("event_id", order.alias("order_id"), line.alias("order_item_id"), product.alias("product_id"))
