"""Who may see what: superusers all, others what their permission and their groups' scopes allow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import small

VIEW = "docia.view_document"


def _able(users: DataFrame, groups: DataFrame, permissions: DataFrame, permission: str) -> DataFrame:
    """user_id, group_id: groups of the users who have the permission, of their own or of any group."""
    granted = groups.join(permissions.where(F.col("permission") == permission).select("group_id").distinct(), "group_id", "left_semi").select("user_id")
    own = users.where(F.coalesce(F.array_contains("permissions", permission), F.lit(False))).select("user_id")
    return groups.join(granted.union(own).distinct(), "user_id", "left_semi").select("user_id", "group_id").distinct()


def allowed(users: DataFrame, groups: DataFrame, scopes: DataFrame, engagements: DataFrame, permissions: DataFrame, permission: str = VIEW) -> DataFrame:
    """user_id, num_ej: all that each user may see by scope, once; as many rows as that is.

    users: user_id, is_superuser, permissions of their own (array, or null); groups: user_id, group_id; permissions: group_id, permission; scopes: group_id, pur_org, pur_group;
    engagements: pur_org, pur_group, num_ej. A user needs the permission, of their own or of a group, and a group with the engagement's scope.
    Superusers see all without it and have no rows of their own here. Null keys fit nothing.
    """
    links = engagements.where("num_ej is not null").select("pur_org", "pur_group", "num_ej").distinct()
    mine = _able(users, groups, permissions, permission).join(small(scopes.select("group_id", "pur_org", "pur_group").distinct()), "group_id")
    return mine.select("user_id", "pur_org", "pur_group").distinct().join(links, ["pur_org", "pur_group"]).select("user_id", "num_ej").distinct()


def may_see(pairs: DataFrame, users: DataFrame, groups: DataFrame, scopes: DataFrame, engagements: DataFrame, permissions: DataFrame, permission: str = VIEW) -> DataFrame:
    """pairs (user_id, num_ej) with visible: the user is a superuser, or allowed() has the pair.

    Each pair brings its engagement's scopes to its user's, so what is joined grows with the pairs, not with all that users could see.
    """
    supers = users.where("is_superuser").select("user_id").distinct().withColumn("__super", F.lit(True))
    links = engagements.where("num_ej is not null").select("num_ej", "pur_org", "pur_group").distinct()
    asked = pairs.select("user_id", "num_ej").distinct().join(links, "num_ej")
    mine = _able(users, groups, permissions, permission).join(small(scopes.select("group_id", "pur_org", "pur_group").distinct()), "group_id").select("user_id", "pur_org", "pur_group")
    known = asked.join(mine, ["user_id", "pur_org", "pur_group"], "left_semi").select("user_id", "num_ej").distinct().withColumn("__yes", F.lit(True))
    held = pairs.join(supers, "user_id", "left").join(known, ["user_id", "num_ej"], "left")
    return held.withColumn("visible", F.coalesce("__super", "__yes", F.lit(False))).drop("__super", "__yes")
