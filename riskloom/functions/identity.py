"""Who a row belongs to: deterministic ids, effective agents, roles, keystroke identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The OID name space of version-5 UUIDs, and characters that hosts are trimmed of.
OID, BLANKS = "6ba7b8129dad11d180b400c04fd430c8", " \t\r\n\f\v"
#: Names that stand for no one.
NOBODY, SERVICE = ("nan", "none", "null", "undefined", ""), ("system", "local system")


def uuid5(name: Column) -> Column:
    """The version-5 UUID of a name in the OID name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(OID)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def observation_id(payload_id: Column, collector: Column, ordinal: Column) -> Column:
    """Ids of a collector's results in a snapshot; from the second on they carry their number."""
    stem = F.concat(payload_id, F.lit(":col:"), collector)
    return uuid5(F.when(ordinal > 0, F.concat(stem, F.lit(":"), ordinal.cast("string"))).otherwise(stem))


def effective_agent(agent: Column, host: Column) -> Column:
    clean = F.btrim(F.coalesce(host, F.lit("")), F.lit(BLANKS))
    of_host = F.concat(F.lit("AGENT-"), clean)
    aid, known = F.trim(agent), clean != ""
    filled = F.replace(F.replace(aid, F.lit("{hostname}"), clean), F.lit("{computername}"), clean)
    return (
        F.when(F.coalesce(agent, F.lit("")) == "", F.when(known, of_host).otherwise("AGENT-UNKNOWN"))
        .when((aid == "") | F.upper(aid).isin("AUTO", "AGENT-DEFAULT"), F.when(known, of_host).otherwise(aid))
        .when(filled != aid, filled)
        .when((F.upper(aid) == "AGENT-SANDY") & known & (F.upper(clean) != "SANDY"), of_host)
        .otherwise(aid)
    )


def role_of(user: Column, role: Column) -> Column:
    """The role given, in lower case with underscores for blanks; without one, by the user's name."""
    given = F.trim(F.coalesce(role, F.lit("")))
    by_name = F.when(F.lower(user).rlike("admin|sys|root"), "administrator").otherwise("standard_user")
    return F.when(given != "", F.replace(F.lower(given), F.lit(" "), F.lit("_"))).otherwise(by_name)


def _valid(c: Column) -> Column:
    clean = F.trim(c)
    return F.when(~F.lower(clean).isin(*NOBODY), clean)


def keystroke_identity(user: Column, host: Column, agent: Column) -> Column:
    person = F.when(~F.lower(_valid(user)).isin(*SERVICE), _valid(user))
    return F.coalesce(F.concat(person, F.lit("@"), _valid(host)), person, _valid(agent), _valid(host), F.lit("UNKNOWN_DEVICE"))


def truthy(c: Column) -> Column:
    """Flags as booleans, numbers or words; null is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def number(c: Column) -> Column:
    """A number, or zero where it is missing, not a number or not readable."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)


def clock_number(c: Column) -> Column:
    """As ``number``, and 'HH:MM' as hours; booleans as one and zero."""
    text = F.trim(c.cast("string"))
    parts = F.split(text, ":")
    hours = F.try_element_at(parts, F.lit(1)).try_cast("double") + F.try_element_at(parts, F.lit(2)).try_cast("double") / 60.0
    flag = F.when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0)
    return F.coalesce(flag, text.try_cast("double"), hours, F.lit(0.0))
