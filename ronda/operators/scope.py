"""Who may ask, and which sites each of them sees."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ronda import fixed_values as fv
from ronda.schemas import require_columns

# None is everybody; otherwise one address, several, or a frame holding an
# email_login column.
Principals = None | str | Sequence[str] | DataFrame

PROFILE = ("email_login", "nombre_completo", "cliente_rol", "rol_id", "nombre_rol")


def restrict(df: DataFrame, principals: Principals) -> DataFrame:
    """Rows of the given principals; a literal list reaches the scan."""
    if principals is None:
        return df
    if isinstance(principals, DataFrame):
        return df.join(principals.select("email_login"), "email_login", "left_semi")
    if isinstance(principals, str):
        return df.filter(F.col("email_login") == principals)
    return df.filter(F.col("email_login").isin(list(principals)))


def principal_frame(df: DataFrame, principals: Principals) -> DataFrame:
    """The principals a report must answer for, one row each."""
    if isinstance(principals, DataFrame):
        return principals.select("email_login").distinct()
    if principals is None:
        return df.select("email_login").distinct()
    names = [principals] if isinstance(principals, str) else sorted(set(principals))
    return df.sparkSession.createDataFrame([(n,) for n in names], "email_login string")


def permission_profile(perms: DataFrame) -> DataFrame:
    """Active principals with their role and flags."""
    require_columns(perms, "perms")
    return perms.filter("usuario_activo").select(
        *PROFILE,
        F.struct(*fv.PERMISSION_FLAGS).alias("permisos"),
        "ver_todas_instalaciones",
    )


def permitted(perms: DataFrame, flag: str | None = None) -> DataFrame:
    """Active principals, of whom a flag is true if one is named."""
    if flag is not None and flag not in fv.PERMISSION_FLAGS:
        raise ValueError(f"unknown permission flag: {flag}")
    active = perms.filter("usuario_activo")
    if flag is not None:
        active = active.filter(flag)
    return active.select("email_login")


def visible_rows(grants: DataFrame, principals: Principals = None) -> DataFrame:
    """Grants that let somebody see a site, repeated ones included."""
    require_columns(grants, "grants")
    seen = grants.filter("puede_ver").select("email_login", "cliente_rol", "instalacion_rol")
    return restrict(seen, principals)


def visible_client_sites(grants: DataFrame, principals: Principals = None) -> DataFrame:
    """One row per principal, client and site; ``accesos`` is how often it was
    granted.  Measures are multiplied by it instead of repeating the rows."""
    rows = visible_rows(grants, principals)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("accesos"))


def with_namesakes(visible: DataFrame) -> DataFrame:
    """Marks in ``varios`` the sites a principal sees under several clients."""
    same_name = W.partitionBy("email_login", "instalacion_rol")
    return visible.withColumn("varios", F.count(F.lit(1)).over(same_name) > 1)


def nearby(visible: DataFrame, principals: Principals) -> Callable[[DataFrame, list[str]], DataFrame]:
    """Narrows facts, by any key columns of ``visible``, to the sites that a few named principals see.

    With all principals, or a frame of them, facts come down to site grain as
    they are.  For named ones facts of other sites are left out by a semi join,
    which the optimizer places and carries out by the sizes it meets: sites that
    are few are broadcast by it, and of many a bloom filter or the partitions
    they lie in reach the scan.  Nothing is counted while the plan is made.
    """
    if principals is None or isinstance(principals, DataFrame):
        return lambda facts, keys: facts
    return lambda facts, keys: facts.join(visible.select(*keys).distinct(), keys, "left_semi")


def near(facts: DataFrame, visible: DataFrame, keys: list[str], principals: Principals) -> DataFrame:
    """As :func:`nearby` for a report that narrows one table."""
    return nearby(visible, principals)(facts, keys)


def visible_sites(grants: DataFrame, principals: Principals = None) -> DataFrame:
    """As above for the reports that look at the site alone, not the client."""
    return by_site(visible_client_sites(grants, principals))


def by_site(visible: DataFrame) -> DataFrame:
    """One row per principal and site of what :func:`visible_client_sites` gives."""
    return visible.groupBy("email_login", "instalacion_rol").agg(F.sum("accesos").alias("accesos"))
