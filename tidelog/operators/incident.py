"""The profile of an incident: who attacked, what was run, what was reached."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import basename, first_token
from ..logframe import LogFrame
from .correlation import failures_then_success, scope



@dataclass(frozen=True)
class Technique:
    """A command shows a stage if it names one of the programs (any, if none is given; ``invoked``: as what is run), holds all of one group of texts and any of another."""

    stage: str
    programs: tuple[str, ...] = ()
    every: tuple[str, ...] = ()
    some: tuple[str, ...] = ()
    invoked: bool = False


#: Public techniques of attackers (ATT&CK number behind), by the programs that carry them out and their arguments.
TECHNIQUES = [
    Technique("download", ("curl", "wget"), ("://",)),  # T1105
    Technique("download", ("certutil",), ("urlcache",)),  # T1105
    Technique("download", ("bitsadmin",), ("transfer",)),  # T1197
    Technique("sensitive_read", some=("/etc/passwd", "/etc/shadow", "/etc/gshadow", "/etc/sudoers", "/etc/ssh/sshd_config")),  # T1003.008
    Technique("sensitive_read", some=(".ssh", "id_rsa", "id_ed25519", "authorized_keys", ".git-credentials", ".kube/config", "/var/lib/mysql")),  # T1552.001, T1552.004
    Technique("payload", ("gcc", "cc", "g++", "clang", "make", "go", "rustc"), some=("/tmp/", "/dev/shm/", "/var/tmp/", "exploit", "payload")),  # T1587.001
    Technique("payload", ("chmod",), ("+x",)),  # T1222.002
    Technique("exploit", ("pkexec", "dirtypipe", "dirty_pipe", "dirtypipe-exploit"), invoked=True),  # T1068
    Technique("exploit", ("sudoedit",), ("-s",), invoked=True),  # T1068
    Technique("credential_dump", ("mimikatz", "nanodump", "secretsdump.py", "secretsdump")),  # T1003
    Technique("credential_dump", some=("sekurlsa::", "lsadump::")),  # T1003
    Technique("credential_dump", ("procdump", "procdump64"), ("lsass",)),  # T1003.001
    Technique("credential_dump", ("rundll32",), ("comsvcs", "minidump")),  # T1003.001
    Technique("persistence", ("schtasks",), ("/create",)),  # T1053.005
    Technique("persistence", ("crontab", "new-service")),  # T1053.003, T1543.003
    Technique("persistence", ("sc",), ("create", "binpath")),  # T1543.003
    Technique("persistence", every=("currentversion", "run"), some=("reg add", "set-itemproperty", "new-itemproperty")),  # T1547.001
    Technique("remote_execution", ("psexec", "psexec64", "winrs", "smbexec", "smbexec.py", "wmiexec.py")),  # T1569.002, T1021
    Technique("remote_execution", ("wmic",), ("process", "call", "create")),  # T1047
    Technique("anti_forensics", ("vssadmin",), ("delete", "shadows")),  # T1490
    Technique("anti_forensics", ("wevtutil",), some=(" cl ", "clear-log")),  # T1070.001
    Technique("anti_forensics", ("history",), ("-c",)),  # T1070.003
    Technique("encoded_command", ("powershell", "pwsh"), some=(" -e ", " -enc", "frombase64string", "downloadstring", "iex")),  # T1059.001
]


def programs(command: Column) -> Column:
    """The last path parts of a command's words, without ``.exe``."""
    words = F.filter(F.split(F.lower(command), r"[\s\"'`;|&()]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.regexp_replace(basename(w), r"\.exe$", ""))


def invoked(command: Column) -> Column:
    """The program that a command runs; what sudo is given, unless that is an option."""
    names = programs(command)
    first, second = F.get(names, F.lit(0)), F.get(names, F.lit(1))
    return F.when((first == "sudo") & second.isNotNull() & ~second.startswith("-"), second).otherwise(first)


def shows(command: Column, t: Technique) -> Column:
    text = F.concat(F.lit(" "), F.lower(command), F.lit(" "))
    out = F.lit(True)
    if t.programs:
        names = F.array(*map(F.lit, t.programs))
        out = F.array_contains(names, invoked(command)) if t.invoked else F.arrays_overlap(programs(command), names)
    for held in t.every:
        out = out & text.contains(held)
    if t.some:
        out = out & functools.reduce(lambda a, b: a | b, (text.contains(held) for held in t.some))
    return out


#: Executables of known exploits.
CVES = {"sudoedit": "CVE-2021-3156", "pkexec": "CVE-2021-4034", "dirtypipe": "CVE-2022-0847", "dirty_pipe": "CVE-2022-0847"}


def attackers(frame: LogFrame, least: int = 3) -> DataFrame:
    """Users and addresses with many failures; ``has_success_after`` is told apart from the failures."""
    return failures_then_success(frame, least)


def stages(frame: LogFrame) -> DataFrame:
    """pos, stage, tool for every stage that a command shows."""
    command = F.col("command")
    found = F.array_distinct(F.array_compact(F.array(*(F.when(shows(command, t), F.lit(t.stage)) for t in TECHNIQUES))))
    return frame.df.where(frame.value("command") != "").select("pos", F.explode(found).alias("stage"), F.lower(basename(first_token(command))).alias("tool"))


def profile(frame: LogFrame, least: int = 3) -> DataFrame:
    """stage, n_rows, first, last (pos), tools of the rows in the attackers' scope, in the order of their first rows."""
    actors = attackers(frame, least).where("has_success_after").select("username", "source_ip")
    inside = frame.on(scope(frame, actors))
    out = stages(inside).groupBy("stage").agg(F.count("*").alias("n_rows"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))
    return out.orderBy("first", "stage")


def exploits(frame: LogFrame) -> DataFrame:
    """pos, cve of commands whose executable is that of a known exploit."""
    tool = F.lower(basename(first_token(F.col("command"))))
    cve = F.create_map(*(F.lit(x) for pair in CVES.items() for x in pair))[tool]
    return frame.df.select("pos", cve.alias("cve")).where("cve is not null")


def platform(frame: LogFrame) -> DataFrame:
    """windows, linux and platform by the votes of rows."""
    text = F.concat_ws(" ", *(frame.value(f) for f in ("event_type", "process_name", "command", "message") if f in frame.fields))
    votes = frame.df.agg(F.count_if(text.rlike(r"\.exe\b|powershell|eventid|sysmon|\\\\windows")).alias("windows"), F.count_if(text.rlike(r"\bsudo\b|\bsshd\b|/etc/|/tmp/|auditd|\bexecve\b")).alias("linux"))
    return votes.select("*", F.when(F.col("windows") > F.col("linux"), "windows").when(F.col("linux") > 0, "linux").otherwise("unknown").alias("platform"))


def first_after(frame: LogFrame, stage: str) -> DataFrame:
    """pos and command of the first command after the last row of a stage."""
    last = stages(frame).where(F.col("stage") == stage).agg(F.max("pos")).scalar()
    rows = frame.df.where((frame.value("command") != "") & (F.col("pos") > last))
    return rows.orderBy("pos").limit(1).select("pos", "command")


#: Words of profiles with weights.
PROFILES = {"authentication": {"login": 3, "sshd": 3, "password": 2, "session": 1}, "web": {"http": 3, "get ": 2, "post ": 2, "status": 1}, "network": {"tcp": 2, "udp": 2, "port": 1, "destination": 1}, "endpoint": {"process": 3, "command": 2, "sudo": 2, "image": 1}}


def classify(frame: LogFrame, margin: int = 2) -> DataFrame:
    """profile, score of the kind of log: words that any row holds add their weights; mixed if the best leads by less than ``margin``."""
    text = F.lower(F.concat_ws(" ", *(F.concat_ws(" ", F.lit(f), frame.value(f)) for f in frame.fields)))
    words = sorted({w for p in PROFILES.values() for w in p})
    held = frame.df.agg(*(F.coalesce(F.max(text.contains(w)), F.lit(False)).alias(f"w{k}") for k, w in enumerate(words)))
    points = {p: sum((F.when(F.col(f"w{words.index(w)}"), n).otherwise(0) for w, n in ws.items()), F.lit(0)) for p, ws in PROFILES.items()}
    scores = held.select(F.explode(F.array(*(F.struct(s.alias("score"), F.lit(p).alias("profile")) for p, s in points.items()))).alias("x")).select("x.profile", "x.score")
    ranked = scores.agg(F.reverse(F.array_sort(F.collect_list(F.struct("score", "profile")))).alias("r"))  # four rows
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return ranked.select(F.when(first["score"] - second["score"] >= margin, first["profile"]).otherwise("mixed").alias("profile"), first["score"].alias("score"))
