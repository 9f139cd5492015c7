"""How an actor got on: attempts to gain privileges, what ran as root after them, what was fetched and which files were read.

All functions take the log of an actor's rows (``identity.scope``) and look at what was run, not at what a text mentions. Equal findings are one
row with a number and the first place, by partial aggregates, so a scanner that repeats a command adds no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import basename, first_token
from ..functions.iocs import URL
from ..logframe import LogFrame
from .identity import UNSET

#: Programs that run others with more rights, and options with which they only tell of them.
ESCALATORS = ("sudoedit", "sudo", "su", "pkexec", "doas", "runuser")
CHECK = r"(?i)(?:^|\s)--?(?:v|l|h|version|help|list|validate)(?:\s|$)"
#: Programs that hand a file's content on; a search only mentions its name.
READERS = ("cat", "head", "tail", "less", "more", "cp", "tar", "zip", "gzip", "base64", "xxd", "dd", "scp", "sftp", "curl", "wget", "nc", "ncat", "netcat", "rsync", "openssl", "sqlite3", "mysql", "psql", "python", "python3", "sh", "bash", "install")
FETCHERS = ("wget", "curl", "certutil", "bitsadmin", "powershell", "pwsh", "invoke-webrequest", "iwr")
#: Files and folders with accounts and keys: an argument is one of them, or lies in or below it.
SECRET_FILES = ("/etc/shadow", "/etc/gshadow", "/etc/sudoers", "/etc/passwd", "/etc/ssh/sshd_config", "/var/lib/mysql")
SECRET_NAMES = (".ssh", "id_rsa", "id_ed25519", "authorized_keys", ".git-credentials", ".kube")
ARCHIVE = r"(?i)\.(?:tar|tgz|t?gz|zip|rar|7z|xz|bz2)$"
DUMP = r"(?i)(?:lsass|ntds|(?:^|[\\/])(?:sam|system|security))\.(?:dmp|dit|hive?|save)$"


def _program(frame: LogFrame) -> Column:
    """What a command runs: the last part of its first word's path, without ``.exe``, in lower case."""
    return F.regexp_replace(F.lower(basename(first_token(F.coalesce(F.col("command"), F.lit(""))))), r"\.exe$", "")


def _root(frame: LogFrame, fields: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (frame.value(f) == "0" for f in fields if f in frame.fields), F.lit(False))


def attempts(frame: LogFrame, programs: tuple[str, ...] = ESCALATORS) -> DataFrame:
    """program, command, pos (first), n, is_check, as_root: runs of programs that give more rights. Checks, which only tell of rights, rank behind the others; then pos decides."""
    program = _program(frame)
    rows = frame.df.where(program.isin(*programs)).select(program.alias("program"), "command", "pos", _root(frame, ("uid", "euid")).alias("as_root"))
    out = rows.groupBy("program", "command").agg(F.min("pos").alias("pos"), F.count("*").alias("n"), F.max("as_root").alias("as_root"))
    return out.select("program", "command", "pos", "n", F.col("command").rlike(CHECK).alias("is_check"), "as_root").orderBy("is_check", "pos")


def root_commands(frame: LogFrame, by: str = "uid") -> DataFrame:
    """command, pid, pos (first), n of what ran as root (``by`` holds 0) for somebody who had logged in: a login number that is set."""
    if by not in frame.fields or "auid" not in frame.fields:
        return frame.df.limit(0).select(F.lit("").alias("command"), F.lit("").alias("pid"), "pos", F.lit(0).cast("long").alias("n"))
    known = (frame.value("auid") != "") & ~frame.value("auid").isin(UNSET)
    pid = frame.value("pid") if "pid" in frame.fields else F.lit("")
    rows = frame.df.where((frame.value("command") != "") & (frame.value(by) == "0") & known)
    return rows.groupBy("command", pid.alias("pid")).agg(F.min("pos").alias("pos"), F.count("*").alias("n"))


def root_shell(frame: LogFrame, programs: tuple[str, ...] = ESCALATORS, by: str = "uid") -> DataFrame:
    """pos, command of the first root command behind the strongest attempt: its first one that is no check, else the first check. No row without either."""
    top = attempts(frame, programs).limit(1).select(F.col("pos").alias("_top"))
    return root_commands(frame, by).join(F.broadcast(top)).where(F.col("pos") > F.col("_top")).orderBy("pos", "command").limit(1).select("pos", "command")  # top is one row


def downloads(frame: LogFrame) -> DataFrame:
    """url, kind (payload for archives, else tool), tool, pos (first), n of what a program for fetching was given. A tool is the URL's last part without its ending."""
    words = F.split(F.lower(F.coalesce(F.col("command"), F.lit(""))), r"[\s;|&()\"']+")
    names = F.transform(words, lambda w: F.regexp_replace(basename(w), r"\.exe$", ""))
    fetched = F.arrays_overlap(names, F.array(*map(F.lit, FETCHERS)))
    urls = F.transform(F.regexp_extract_all("command", F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[)&,;.]+$", ""))
    out = frame.df.where((frame.value("command") != "") & fetched).select("pos", F.explode(F.array_distinct(urls)).alias("url")).groupBy("url").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    name = F.regexp_extract("url", r"//[^/?#]*/(?:[^?#]*/)?([^/?#]*)", 1)
    tool = F.regexp_replace(name, r"(?i)\.(?:sh|py|pl|bin|elf|exe|ps1|bat|dll)$", "")
    return out.select("url", F.when(name.rlike(ARCHIVE), "payload").otherwise("tool").alias("kind"), tool.alias("tool"), "pos", "n").where("tool <> ''")


def reads(frame: LogFrame, files: tuple[str, ...] = SECRET_FILES, names: tuple[str, ...] = SECRET_NAMES) -> DataFrame:
    """path, command, as_root, pos (first), n of files with accounts or keys that a reader was given as an argument, those read as root first. What root read and what others tried stay apart."""
    secret = lambda w: reduce(lambda a, b: a | b, [(w == f) | w.startswith(f"{f}/") for f in files] + [F.array_contains(F.split(w, "/"), n) for n in names], F.lit(False))
    words = F.filter(F.split(F.trim("command"), r"\s+"), lambda w: ~w.startswith("-"))
    given = F.array_distinct(F.filter(words, secret))
    rows = frame.df.where(_program(frame).isin(*READERS)).select("command", "pos", _root(frame, ("uid", "euid")).alias("as_root"), F.explode(given).alias("path"))
    return rows.groupBy("path", "command", "as_root").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).orderBy(F.desc("as_root"), "pos", "path")


def accesses(frame: LogFrame) -> DataFrame:
    """kind, source, target, pos (first), n: processes that opened the one that holds passwords (event 10) and dumps of it or of account files that were written (event 11)."""
    value = lambda c: frame.value(c) if c in frame.fields else F.lit("")
    image, file = value("targetimage"), value("targetfilename")
    opened = (value("event_id") == "10") & image.rlike(r"(?:^|[\\/])lsass(?:\.exe)?$")
    dumped = (value("event_id") == "11") & file.rlike(DUMP)
    source = F.when(opened, F.when(value("process_name") == "", F.lit("unknown process")).otherwise(value("process_name"))).otherwise(file)
    rows = frame.df.where(opened | dumped).select(F.when(opened, "process access").otherwise("file created").alias("kind"), source.alias("source"), F.when(opened, image).otherwise(file).alias("target"), "pos")
    return rows.groupBy("kind", "source", "target").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))


def story(frame: LogFrame, programs: tuple[str, ...] = ESCALATORS, files: tuple[str, ...] = SECRET_FILES, by: str = "uid") -> DataFrame:
    """part, what, detail, pos, n of all findings: attempt or check, root, root shell, download or payload, root read or read, access."""
    form = lambda df, part, what, detail: df.select(part.alias("part"), what.alias("what"), detail.alias("detail"), "pos", "n")
    c = F.col
    parts = [
        form(attempts(frame, programs), F.when(c("is_check"), "check").otherwise("attempt"), c("program"), c("command")),
        form(root_commands(frame, by), F.lit("root"), c("command"), c("pid")),
        form(root_shell(frame, programs, by).withColumn("n", F.lit(1).cast("long")), F.lit("root shell"), c("command"), F.lit("")),
        form(downloads(frame), F.when(c("kind") == "payload", "payload").otherwise("download"), c("tool"), c("url")),
        form(reads(frame, files), F.when(c("as_root"), "root read").otherwise("read"), c("path"), c("command")),
        form(accesses(frame), F.lit("access"), c("source"), c("target")),
    ]
    return reduce(DataFrame.unionByName, parts)
