"""The rows that a question may rest on, found by its words, by what the log's fields are called and by what the best rows share with others.

No kind of question has a handler of its own: a question's words, the names of the fields that seem to answer it and a few words
of the trade score each row; rows near the best one are kept and what shares an entity with them follows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..logframe import LogFrame
from ..stored import written

#: Words of questions that tell rows from each other in no log.
COMMON = set("a all an and any are as at be by can could did do does event events evidence for from give how in is log logs me most of on or please relevant show tell that the there these this those to was were what when where which who why with would".split())
#: What logs write where a question says something else. A parameter; words under three letters are only looked for as words of a question.
TRADE = {
    "reverse shell": ["/dev/tcp", "ncat", "netcat", "socat", "tcpclient", "bash -i"],
    "shell": ["bash", "powershell", "pwsh", "cmd.exe", "zsh"],
    "download": ["curl", "wget", "invoke-webrequest", "outfile"],
    "exfiltration": ["upload", "scp", "sftp", "rsync", "transfer"],
    "privilege": ["sudo", "pkexec", "doas", "uid=0", "setuid"],
    "persistence": ["cron", "systemd", "schtasks", "startup", "authorized_keys"],
    "credential": ["password", "token", "ntlm", "kerberos", "/etc/shadow"],
    "authentication": ["login", "accepted", "failed", "session"],
    "risk": ["critical", "high", "severity", "alert"],
}
#: What fields are called that hold the answer to a word.
HINTS = {"ip": ["ip", "addr"], "port": ["port"], "user": ["user", "acct", "account"], "command": ["command", "cmd", "argv"], "process": ["process", "image", "pid"], "file": ["file", "path"], "domain": ["domain", "host", "dns"], "hash": ["hash", "sha", "md5"], "session": ["session"]}
#: Points of a phrase, a word, a term of the trade, a field; the share of the best score that rows need, the least score, and what a row is worth that only shares an entity.
PHRASE, WORD, TERM, FIELD, BAND, LEAST, RELATED = 40, 4, 7, 9, 0.81, 8.0, 0.45
#: What an entity is, and how many of the best rows hand theirs on.
LINKS, ANCHORS = ["source_ip", "destination_ip", "username", "process_name", "pid", "ppid"], 8


def words(question: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.findall(r"[a-z0-9_./:-]*[a-z0-9_/]", question.lower()) if len(w) > 1 and w not in COMMON))


def trade_terms(question: str, trade: dict[str, list[str]] | None = None) -> list[str]:
    """What the trade calls the things that a question names, then the question's own words."""
    low = f" {' '.join(re.findall('[a-z0-9]+', question.lower()))} "
    named = [t for name, terms in (TRADE if trade is None else trade).items() if f" {name} " in low or f" {name}s " in low for t in terms]
    return list(dict.fromkeys(named + words(question)))


def answering(frame: LogFrame, question: str, most: int = 20) -> dict[str, int]:
    """Fields that seem to hold the answer, with how many words of the question are in their names; best first. A name must fit; values alone don't make a field an answer."""
    asked = set(words(question)) | {w.rstrip("s") for w in words(question)}
    share = frame.df.agg(F.count("*").alias("n"), *(F.count_if(frame.value(f) != "").alias(f) for f in frame.fields)).first()
    ranked = []
    for f in frame.fields:
        parts = set(re.findall("[a-z0-9]+", f.lower()))
        hints = sum(h in f.lower() for word, hs in HINTS.items() if word in asked for h in hs)
        score = 5 * len(asked & parts) + 4 * hints + (3 * share[f] / share["n"] if share["n"] else 0)
        if score >= 5:
            ranked.append((-score, f, len(asked & parts)))
    return {f: n for _, f, n in sorted(ranked)[:most]}


def score(frame: LogFrame, question: str, fields: dict[str, int], trade: dict[str, list[str]] | None = None) -> Column:
    """The points of a row: the whole question in it, its words, terms of the trade, and fields that seem to hold the answer. Empty values give none."""
    text = F.concat_ws(" ", *(F.when(frame.value(f) != "", F.concat(F.lit(f"{f.lower()}="), frame.value(f))) for f in frame.fields))
    points = [PHRASE * text.contains(question.strip().lower()).cast("int")] if question.strip() else []
    points += [WORD * text.contains(w).cast("int") for w in words(question)]
    points += [TERM * text.contains(t).cast("int") for t in trade_terms(question, trade) if len(t) >= 3]
    points += [(FIELD + min(FIELD, 3 * n)) * (frame.value(f) != "").cast("int") for f, n in fields.items()]
    if "port" in words(question):
        port = lambda f: F.coalesce(frame.value(f).try_cast("int").between(1, 65535), F.lit(False)).cast("int")
        ports = [f for f in frame.fields if "port" in f.lower()]
        points += [22 * port(f) for f in ports if f in fields] + ([18 * F.greatest(*map(port, ports), F.lit(0))] if ports else [])
    return sum(points, F.lit(0)).cast("double")


def retrieve(frame: LogFrame, question: str, most: int = 40, hops: int = 1, trade: dict[str, list[str]] | None = None) -> DataFrame:
    """pos, score and hop (0: found by its own words) of at most ``most`` rows.

    Rows with at least BAND of the best score are found, or the best one alone where that is below LEAST. If there are several and room is left, rows
    follow that share an entity with the ANCHORS best, in order of pos; with more ``hops`` those hand on theirs. Every row is scored, once.
    ``most`` rows hand on a handful of values each, so what is looked for stays small whatever the log's size.
    """
    links = [f for f in LINKS if f in frame.fields]
    scored = written(frame.df.select("pos", score(frame, question, answering(frame, question), trade).alias("score"), *(frame.value(f).alias(f) for f in links)), "scored")
    best = scored.agg(F.max("score")).first()[0]
    if not best:
        return scored.limit(0).select("pos", "score", F.lit(0).alias("hop"))
    ranked = [F.desc("score"), F.col("pos")]
    near = scored.where((F.col("score") >= max(LEAST, BAND * best)) & (F.col("score") > 0))
    chosen = written((near if max(LEAST, BAND * best) <= best else scored).orderBy(*ranked).limit(most if max(LEAST, BAND * best) <= best else 1).withColumn("hop", F.lit(0)), "chosen")
    frontier, held = chosen.orderBy(*ranked).limit(ANCHORS), chosen.count()
    pairs = lambda df: df.select("pos", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in links))).alias("p")).where("p.value <> ''").select("pos", "p.*")
    for hop in range(1, hops + 1):
        if held < 2 or held >= most or not links:
            break
        values = F.broadcast(pairs(frontier).select("field", "value").distinct())  # at most ``most`` rows times the fields
        met = pairs(scored).join(values, ["field", "value"], "left_semi").select("pos").distinct()
        rest = scored.join(met, "pos", "left_semi").join(F.broadcast(chosen.select("pos")), "pos", "left_anti")  # at most ``most`` rows
        found = written(rest.orderBy("pos").limit(most - held).withColumn("score", F.greatest(F.lit(1.0), F.col("score") * RELATED)).withColumn("hop", F.lit(hop)), "related")
        frontier, more = found, found.count()
        if more == 0:
            break
        chosen, held = chosen.unionByName(found), held + more
    return chosen.select("pos", "score", "hop")
