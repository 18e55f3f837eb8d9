"""The archive: which messages are new, which are repeated, and who the users are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BY = ["user_id", "message_key"]


def first_in_request(messages: DataFrame) -> DataFrame:
    """The first message of each key."""
    w = Window.partitionBy(*_BY).orderBy("ordinal")
    return messages.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def delta(messages: DataFrame, archive: DataFrame) -> DataFrame:
    """Messages whose key the archive does not hold, each key once."""
    return first_in_request(messages).join(archive.select(*_BY).distinct(), _BY, "left_anti")


def duplicates(messages: DataFrame, archive: DataFrame) -> DataFrame:
    """The others: keys that the archive holds, and repeats within the messages."""
    w = Window.partitionBy(*_BY).orderBy("ordinal")
    known = archive.select(*_BY).distinct().withColumn("__known", F.lit(True))
    marked = messages.withColumn("__n", F.row_number().over(w)).join(known, _BY, "left")
    return marked.where((F.col("__n") > 1) | F.col("__known")).drop("__n", "__known")


def archived_keys(archive: DataFrame, user_id: str) -> DataFrame:
    return archive.where(F.col("user_id") == user_id).select("message_key")


def new_users(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Users that `users` lacks; nothing but the id is kept of them."""
    return messages.select("user_id").distinct().join(users.select("user_id"), "user_id", "left_anti")


def numbered(messages: DataFrame, start: int = 0) -> DataFrame:
    """Ids in the order of user, ordinal and key, per user, so that numbering needs no global sort."""
    w = Window.partitionBy("user_id").orderBy("ordinal", "message_key")
    return messages.withColumn("id", F.row_number().over(w) + start)
