"""Users and roles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def users_with_role(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Every user with the name of their role. AQE broadcasts the roles once it saw their size."""
    named = roles.select(F.col("id").alias("role_id"), F.col("name").alias("role"))
    return users.join(named, "role_id")


def list_users(users: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest users first; the id breaks ties."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset not negative")
    return users.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)
