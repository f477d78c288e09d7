"""Explainable rules over flat features: detections, context scaling, correlation groups, superposition.

All of it is arithmetic inside a row: a snapshot's detections are a short array, so no rule shuffles.
A missing, unreadable or NaN feature counts as zero.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.identity import number, truthy
from riskloom.functions.planned import planned

#: Weights of domains, weights of confidences, sensitivity of a profile in FILE, HTTP, LOGON, DEVICE.
DOMAINS = {"FILE": 0.35, "DEVICE": 0.30, "CREDENTIAL": 0.25, "EXECUTION": 0.25, "DECEPTION": 0.25, "LOGON": 0.20, "HTTP": 0.15}
CONFIDENCE = {"VERY_HIGH": 0.95, "HIGH": 0.90, "MEDIUM": 0.70, "LOW": 0.40}
PROFILES = {
    "OFFICE_WORKER": (1.0, 1.0, 1.0, 1.0), "DEVELOPER": (0.35, 0.6, 0.7, 0.8), "SYSADMIN": (0.6, 0.7, 0.3, 0.7), "DATA_ENGINEER": (0.4, 0.3, 0.6, 0.7),
    "MEDIA_CREATOR": (0.4, 0.5, 0.8, 0.3), "DEFAULT": (0.8, 0.8, 0.8, 0.8),
}
#: Names of build tools' processes, and folders whose files are not looked at as strictly.
BUILD_TOOLS = (
    "git.exe", "cargo.exe", "rustc.exe", "msbuild.exe", "cl.exe", "javac.exe", "npm.cmd", "node.exe", "yarn.cmd", "pnpm.cmd",
    "docker.exe", "dockerd.exe", "mvn.cmd", "gradlew.bat", "python.exe", "pytest.exe", "go.exe", "code.exe",
)
QUIET_PATHS = (
    r"[\\/]node_modules[\\/]",
    r"[\\/]\.git[\\/]",
    r"[\\/]target[\\/]",
    r"[\\/]build[\\/]",
    r"[\\/]dist[\\/]",
    r"[\\/]\.m2[\\/]",
    r"[\\/]\.cargo[\\/]",
    r"[\\/]\.cache[\\/]",
    r"[\\/]AppData[\\/]Local[\\/]Temp[\\/]",
)
#: Which detections weaken each other as one group; any other is a group of its own.
GROUPS = {
    "FILE_EXFIL_GROUP": ("Bulk File Collection", "Broad File Collection", "Sensitive File Collection"),
    "DEVICE_USB_GROUP": ("File Transfer to Removable Media", "Bulk USB File Transfer", "Unapproved USB Device"),
    "FILE_SABOTAGE_GROUP": ("Mass File Deletion",), "HONEYTOKEN_GROUP": ("Honeytoken Access",), "SABOTAGE_GROUP": ("After-Hours Persistence Tampering",),
    "HTTP_EXFIL_GROUP": ("Cloud Upload Correlated with File Collection",), "HTTP_PRECURSOR_GROUP": ("File-Sharing Site Visit",),
    "LOGON_AUTH_GROUP": ("Failed Authentication Activity",), "LOGON_TIME_GROUP": ("After-Hours Logon Anomaly",), "LOGON_ASSET_GROUP": ("Multi-PC Access Anomaly",),
}
#: Words that place a detection in a domain; the first that is found decides, FILE where none is.
DOMAIN_WORDS = (
    ("DECEPTION", ("honeytoken", "decoy")), ("CREDENTIAL", ("lsass", "mimikatz", "credential dump")), ("EXECUTION", ("memory", "injection", "executable region")),
    ("HTTP", ("http", "cloud", "domain", "network", "browsing", "sharing", "upload")), ("FILE", ("file", "credential")), ("DEVICE", ("usb", "device")),
    ("LOGON", ("logon", "session", "pc", "account", "auth")),
)
TRANSFERS = ("daily_files_to_removable_count", "external_drive_file_copy", "usb_file_transfer_count")
UPLOADS = ("cloud_storage_uploads", "large_uploads", "upload_bytes", "cloud_upload_bytes", "large_upload_bytes")
CHANGES = ("service_modification_count", "privilege_change_count", "persistence_modification_count", "driver_modification_count")


def domain_of(scenario: str) -> str:
    name = scenario.lower()
    return next((d for d, words in DOMAIN_WORDS if any(w in name for w in words)), "FILE")


def group_of(scenario: str) -> str:
    return next((g for g, names in GROUPS.items() if scenario in names), f"GROUP_{scenario}")


class Features:
    """Features of a frame by name; those that it doesn't have are missing."""

    def __init__(self, df: DataFrame):
        self.types = dict(df.dtypes)

    def raw(self, *names: str) -> Column:
        """The first that is there and not null, as a number or null."""
        found = [F.nanvl(F.col(n) if self.types[n] == "double" else F.col(n).try_cast("double"), F.lit(None)) for n in names if n in self.types]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    def n(self, *names: str) -> Column:
        found = [n for n in names if n in self.types]
        if not found:
            return F.lit(0.0)
        if all(self.types[n] == "double" for n in found):
            return F.nanvl(F.coalesce(*(F.col(n) for n in found), F.lit(0.0)), F.lit(0.0))
        return number(F.coalesce(*(F.col(n).cast("string") for n in found))) if len(found) > 1 else number(F.col(found[0]))

    def most(self, *names: str) -> Column:
        found = [self.n(n) for n in names if n in self.types]
        return F.lit(0.0) if not found else found[0] if len(found) == 1 else F.greatest(*found)

    def total(self, *names: str) -> Column:
        return reduce(add, (self.n(n) for n in names))

    def flag(self, name: str) -> Column:
        if self.types.get(name) == "boolean":
            return F.coalesce(F.col(name), F.lit(False))
        return truthy(F.col(name)) if name in self.types else F.lit(False)

    def text(self, *names: str) -> Column:
        found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in self.types]
        return F.coalesce(*found, F.lit(""))


def rule_table(f: Features) -> list[tuple[str, str, str, object, str, Column]]:
    """(scenario, id, severity, score, confidence, condition) of every rule, in the order of evaluation."""
    logons, late = f.n("successful_logons", "logon_count"), f.n("after_hours_logon")
    accesses, unique = f.n("file_access_count"), f.most("daily_unique_filename_count", "unique_filename_count")
    new, sensitive = f.n("daily_new_filename_count"), f.n("sensitive_file_access")
    bulk = (accesses >= 500) & (unique >= 100)
    upload = f.most(*UPLOADS) > 0
    hoard = (sensitive > 0) | (F.greatest(f.n("daily_unique_filename_count"), new) >= 50)
    moved = f.most(*TRANSFERS, "large_usb_transfer")
    strict = (F.col("unauthorized_usb_detected").cast("boolean") if f.types.get("unauthorized_usb_detected") == "boolean" else F.lit(False))
    strict = F.coalesce(strict, F.lit(False))
    burst = (f.n("edr_failed_auth_ratio_window", "auth_fail_rate_300s") >= 0.8) & (f.n("edr_failed_auth_events_per_minute_window") * 5 >= 5)
    m, h, low = "MEDIUM", "HIGH", "LOW"
    return [
        ("After-Hours Logon Anomaly", "S1_PRECURSOR", m, 40, m, (late >= 2) & (f.n("daily_after_hours_logon_ratio") >= 0.5) & (logons >= 3)),
        ("Multi-PC Access Anomaly", "AUTH_LATERAL", m, 40, m, (f.most("daily_unique_pc_count", "unique_pc_count") >= 3) & (logons >= 3)),
        ("Failed Authentication Activity", "AUTH_BURST", m, 45, m, (f.n("failed_logons") >= 5) & (f.n("edr_failed_auth_ratio_window", "auth_fail_rate_300s") >= 0.5)),
        ("Bulk File Collection", "S2", h, 75, h, bulk),
        ("Broad File Collection", "S2", m, 45, m, ~bulk & (unique >= 50) & (new >= 25)),
        ("Sensitive File Collection", "S2", h, 70, h, (sensitive > 0) & ((accesses >= 50) | (unique >= 20))),
        ("Mass File Deletion", "FILE_DELETE", m, 50, m, f.most("daily_file_delete_count", "file_delete_count") >= 10),
        ("File Transfer to Removable Media", "S3", h, 80, h, f.total(*TRANSFERS) > 0),
        ("Cloud Upload Correlated with File Collection", "S4", h, 80, h, upload & hoard),
        ("Cloud Upload Without File Correlation", "S4_PRECURSOR", low, 25, m, upload & ~hoard),
        ("File-Sharing Site Visit", "S4_PRECURSOR", low, 10, low, ~upload & (f.n("file_sharing_site_visits") > 0)),
        ("Bulk USB File Transfer", "S3", F.when(moved >= 20, h).otherwise(m), F.when(moved >= 20, 80.0).otherwise(60.0), h, moved > 0),
        ("Unapproved USB Device", "S3_PRECURSOR", m, 40, m, (moved <= 0) & strict),
        ("USB Device Activity", "S3_PRECURSOR", low, 10, low, (moved <= 0) & ~strict & (f.most("usb_connect_count", "daily_device_connect_count") > 0)),
        ("LSASS Credential Dumping Suspected", "S1_CRED_DUMP", "CRITICAL", 100, "VERY_HIGH", f.flag("credential_dumping_suspected")),
        ("Unbacked Executable Memory", "S1_INJECTION", h, 85, h, (f.n("unbacked_executable_regions") > 0) | f.flag("threats_detected")),
        ("Network Tunneling Indicator", "NETWORK_TUNNELING", h, 80, h, (f.n("tunneling_process_count") > 0) | f.flag("tunneling_detected")),
        ("Honeytoken Access", "HONEYTOKEN", "CRITICAL", 100, "VERY_HIGH", f.flag("threat_triggered")),
        ("After-Hours Persistence Tampering", "S1", h, 85, h, f.flag("modifications_detected") & ((late >= 2) | burst)),
    ]


def _sensitivity(profile: Column, place: int) -> Column:
    out = F.lit(PROFILES["DEFAULT"][place])
    for name, values in PROFILES.items():
        out = F.when(profile == name, values[place]).otherwise(out)
    return out


@planned
def detections(df: DataFrame) -> DataFrame:
    """``df`` with ``detections``: what fired, each with its effective score after profile, tool and path.

    What many rules share is a column of its own, so that the plan holds it once.
    """
    f = Features(df)
    profile, tool = F.upper(f.text("system_profile", "user_role")), F.lower(f.text("process_name", "active_process")).isin(*BUILD_TOOLS)
    quiet = F.when(f.text("target_path", "file_path").rlike("(?i)" + "|".join(QUIET_PATHS)), 0.25).otherwise(1.0)
    places = {d: F.col(f"__of_{d}") for d in ("FILE", "HTTP", "LOGON", "DEVICE")}
    shared = df.withColumns({"__profile": profile, "__tool": tool, "__quiet": quiet}).withColumns({f"__of_{d}": _sensitivity(F.col("__profile"), i) for i, d in enumerate(places)})
    found = []
    for pos, (scenario, sid, severity, score, confidence, fires) in enumerate(rule_table(f)):
        domain, group = domain_of(scenario), group_of(scenario)
        trust = 0.2 if domain == "FILE" else 0.5 if domain == "HTTP" and "HTTP_EXFIL" in group else 1.0
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        effective = as_col(score).cast("double") * (F.when(F.col("__tool"), trust).otherwise(1.0) * F.col("__quiet")) * places.get(domain, F.lit(1.0))
        one = F.struct(
            F.lit(pos).alias("pos"), F.lit(scenario).alias("scenario"), F.lit(sid).alias("scenario_id"), as_col(severity).alias("severity"), F.lit(domain).alias("domain"),
            F.lit(group).alias("group_id"), effective.alias("effective"), F.lit(CONFIDENCE[confidence]).alias("certainty"),
        )
        found.append(F.when(fires, one))
    weighed = F.transform(F.array_compact(F.array(*found)), lambda x: x.withField("weighed", x["effective"] * x["certainty"]).dropFields("certainty"))
    return shared.withColumn("detections", weighed).drop("__profile", "__tool", "__quiet", *(f"__of_{d}" for d in places))


def grouped(df: DataFrame) -> DataFrame:
    """``groups``: in each the strongest detection counts whole, the next a fifth, the next a fifth of that."""
    d = F.col("detections")

    def group(g):
        own = F.filter(d, lambda x: x["group_id"] == g)
        ranked = F.reverse(F.array_sort(F.transform(own, lambda x: F.struct(x["weighed"].alias("w"), (-x["pos"]).alias("p"), x["domain"].alias("domain"), x["scenario"].alias("scenario")))))
        score = F.aggregate(F.transform(ranked, lambda x, i: x["w"] * F.pow(F.lit(0.2), i)), F.lit(0.0), add)
        top = F.get(ranked, F.lit(0))
        return F.struct(g.alias("group_id"), top["scenario"].alias("primary"), top["domain"].alias("domain"), F.least(F.lit(100.0), score).alias("score"), F.size(own).alias("rules"))

    return df.withColumn("groups", F.transform(F.array_distinct(F.transform(d, lambda x: x["group_id"])), group))


def superposed(df: DataFrame) -> DataFrame:
    """``rule_score``, ``rule_level``, ``domains``: domains' peaks weighed together, with floors for the surest signs."""
    top = lambda d: F.array_max(F.transform(F.filter("groups", lambda g: g["domain"] == d), lambda g: g["score"]))
    peaks = {d: F.col(f"__of_{d}") for d in DOMAINS}
    weight = reduce(add, (F.when(p.isNotNull(), DOMAINS[d]).otherwise(0.0) for d, p in peaks.items()))
    value = reduce(add, (F.coalesce(p * DOMAINS[d], F.lit(0.0)) for d, p in peaks.items()))
    k, base = F.col("__k"), F.col("__base")
    bonus = F.when((k >= 3) & (base >= 35), F.least(F.lit(10.0), (k - 2) * 5.0)).otherwise(0.0)
    score = F.when(k == 0, 0.0).when(k == 1, F.coalesce(*peaks.values()) * 0.8).otherwise(F.least(F.lit(100.0), base + bonus))
    has = lambda sid: F.exists("detections", lambda x: x["scenario_id"] == sid)
    score = F.when(has("HONEYTOKEN"), 100.0).otherwise(F.greatest(F.when(has("S1_CRED_DUMP"), 95.0).otherwise(0.0), F.least(F.lit(100.0), score)))
    s = F.col("__score")
    level = F.when(s >= 90, "CRITICAL").when(s >= 70, "HIGH").when(s >= 40, "MEDIUM").otherwise("LOW")
    active = F.array_compact(F.array(*(F.when(p.isNotNull(), F.lit(d)) for d, p in peaks.items())))
    df = df.withColumns({f"__of_{d}": top(d) for d in DOMAINS})
    df = df.withColumns({"__k": reduce(add, (p.isNotNull().cast("int") for p in peaks.values())), "__base": value / F.greatest(F.lit(0.01), weight)}).withColumn("__score", score)
    df = df.withColumns({"rule_score": F.round(s, 9), "rule_level": level, "domains": active, "peaks": F.struct(*(p.alias(d) for d, p in peaks.items()))})
    return df.drop("__k", "__base", "__score", *(f"__of_{d}" for d in DOMAINS))


def ranked_detections() -> Column:
    """Detections by severity and effective score, strongest first."""
    rank = lambda x: F.when(x["severity"] == "CRITICAL", 4).when(x["severity"] == "HIGH", 3).when(x["severity"] == "MEDIUM", 2).otherwise(1)
    keyed = F.transform("detections", lambda x: F.struct(-rank(x), -x["effective"], x["pos"], x["scenario"].alias("scenario")))
    return F.transform(F.array_sort(keyed), lambda x: x["scenario"])


@planned
def evaluate(df: DataFrame) -> DataFrame:
    return superposed(grouped(detections(df)))
