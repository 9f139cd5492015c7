"""Claims in plain English against the evidence that they cite and against counts of all of it.

Claims and evidence are read into typed facts (``ip:10.0.0.9``, ``outcome:failure``, ``shows:compromise``). What a claim needs is then
joined with what its evidence shows; what is left over is missing, and what shows the opposite contradicts. Nobody's own label
of a claim is trusted further than as a wish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.iocs import CVE, HEX_RUN, IPV4
from ..stored import written

#: By fact: how claims say it and how evidence shows it. A theme is needed wherever it is spoken of.
THEMES = {
    "theme:authentication": (r"\b(?:authenticat\w*|log ?[io]ns?|logged in|sshd?|credentials?)\b", r"\b(?:user_auth|user_login|\w+_login|authentication|sshd|(?:accepted|failed) password)\b"),
    "theme:process": (r"\b(?:process(?:es)?|execut\w+|commands?|shells?)\b", r"\b(?:execve|command_exec|process|shell)\b|\bcommand="),
    "theme:network": (r"\b(?:networks?|connections?|sockets?|outbound|transfer\w*|traffic)\b", r"\b(?:networks?|connect\w*|sockets?|outbound|transfer\w*|https?|tcp|udp|scp|sftp|rsync|curl|wget|netcat|nc)\b"),
    "theme:privilege": (r"\b(?:root|privileged?|privileges|elevat\w+)\b", r"\be?uid=0\b|\b(?:root|sudo|su|pkexec|privileges?)\b"),
}
#: Outcomes of a login, as evidence records them and as a claim counts or asserts them.
_LOGIN = r"(?:log ?ins?|logons?|authentications?)(?: attempts?| events?)?"
_SEEN = r" (?:occurred|succeeded|(?:was|were) (?:seen|observed|recorded))"
OUTCOMES = {
    "outcome:success": (rf"\bsuccessful {_LOGIN}", r"\b(?:successful_login|accepted password|res=success)\b|\bauthentication[^.;\n]*\bsuccess"),
    "outcome:failure": (rf"\b(?:failed|unsuccessful) {_LOGIN}", r"\b(?:failed_login|failed (?:password|login|authentication)|res=failed)\b|\bauthentication[^.;\n]*\bfail(?:ed|ure)"),
}
#: Conclusions need evidence of their own kind: a failure shows no compromise, an identifier no exploitation.
CONCLUSIONS = {
    "shows:weak credentials": (r"\b(?:weak|insecure) (?:passwords?|credentials?|authentication)\b|\bpassword (?:is|was|appears?) weak\b", r"\b(?:weak (?:password|credential)|(?:password|credential) (?:policy|strength))\b"),
    "shows:compromise": (r"\b(?:compromised?|breach(?:ed)?)\b", r"\b(?:account compromise|successful compromise|compromise_established|compromised=true)\b"),
    "shows:access": (r"\b(?:gave|provided|allowed|enabled|granted) (?:the )?attackers? (?:access|entry)\b|\b(?:gave|provided|allowed|enabled) (?:initial )?access to (?:the )?attacker\b", r"\b(?:successful (?:authentication|login|session)|authenticated|access_granted|session_established)\b"),
    "shows:escalation": (r"\bescalat(?:ed?|ion|ing)(?: of)? privileges?\b|\bprivileges? escalat\w+|\bescalat(?:ed|ion) to root\b", r"\be?uid=0\b|\bprivilege boundary (?:crossed|bypassed)\b|\bgained (?:root|elevated)\b"),
    "shows:exfiltration": (r"\bexfiltrat\w+|\bdata (?:leak|theft|stolen)\b|\bstole\b", r"\b(?:upload(?:ed)?|transferred|scp|sftp|rsync)\b|\bbytes_sent=\"?[1-9]"),
    "shows:attacker": (r"\battacker (?:was|is|used|originated|came from)\b", r"\b(?:attacker|threat actor|malicious source)\b"),
    "shows:exploitation": (r"\bexploited\b|\bexploit(?:ation)? (?:succeeded|worked|was successful)\b", r"\b(?:exploitation succeeded|code execution (?:achieved|observed)|successful exploit|exploit confirmed|execution confirmed)\b"),
    "shows:infection": (r"\binfected\b|\bmalware infection\b", r"\b(?:malware (?:detected|confirmed|identified)|infection confirmed|known malicious hash)\b"),
    "shows:guessing": (r"\bbrute[- ]?forc\w+", r"\b(?:brute[- ]?force|password guess(?:ing)?|credential attack)\b"),
    "shows:no permission": (r"\bunauthori[sz]ed access\b", r"\b(?:unauthori[sz]ed|access_denied|permission_denied|authentication failure)\b"),
    "shows:root": (r"\b(?:as root|root(?:-level)?) (?:execution|command|shell|access)\b", r"\be?uid=0\b|\broot\b"),
    "link:cause": (r"\b(?:caus(?:ed?|es|ing)|led to|resulted in|triggered|due to|because of)\b", r"\b(?:session|request|trace|transaction|correlation|flow)[_ ]?id\b|\bsame (?:session|process|pid)\b|\b(?:caused|triggered) by\b|\bparent[_ ]?process\b"),
}
#: What only evidence shows: the other side of a fact, and that one record tells of many events.
OPPOSITES = {"outcome:success": "outcome:failure", "shows:compromise": "shows:none"}
OTHERS = {"shows:none": r"\bcompromised?\b[^.;\n]*\b(?:false|no|not|absent|failed)\b", "shows:many": r"\b(?:multiple|repeated|at least \d+|\d+ (?:failed )?attempts)\b"}
#: By kind: where its values stand. A word behind "user" is a name only if it is marked as one or can be no English word.
VALUES = {
    "ip": (IPV4, 0),
    "cve": (CVE, 0),
    "hash": (HEX_RUN, 0),
    "user": (r"\b(?:user|username|acct|account)(?:[=:]['\"]?| ['\"]| (?=[a-z.@-]*[\d_]))([\w.@-]*\w)", 1),
    "process": (r"\b(?:process|process_name|proc|comm)[=:]['\"]?([\w./@-]*\w)", 1),
    "command": (r"(?:`|\b(?:command|cmd|proctitle)[=:] ?['\"]?)([\w./-]*\w)", 1),
    "port": (r"port(?:\s(?:is|was)|\s?[=:])?\s?(\d{1,5})\b", 1),
    "path": (r"(?<![\w./:])/(?:[\w.-]+/)*[\w-]+(?:\.[\w-]+)*", 0),
}
NEGATED = r"\b(?:(?:do|does|did|can)(?: not|n't)|cannot|not (?:establish|prove|classif)\w*|no (?:evidence|indication|proof) of|without evidence|unproven|unconfirmed)\b[^.;!?]*"
ADVICE = r"^\W*(?:recommendation|monitor|review|investigate|correlate|consider|implement|enable|disable|verify|check|preserve|collect|escalate|ensure|configure|harden|restrict|rotate|block|allow)\b"
OPEN = r"\binsufficient (?:context|evidence)\b|\brequires? (?:additional )?context\b|\bcannot (?:be )?determined?\b|\bwarrants? (?:further )?context"
HEDGED = r"\b(?:could|may|might|suggest\w*|indicat\w+|potential\w*|possibl[ey]|likely|warrant\w*|risk|malicious|attack\w*|compromise\w*|exfiltrat\w+)\b"
MANY, ALL = r"\b(?:multiple|several|sequence|repeated(?:ly)?)\b", r"\b(?:all|every|each)\b"
COUNTED = rf"\b(\d+) (?:(?:failed|unsuccessful|successful) {_LOGIN}|(?:matching )?(?:events?|records?))\b"


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _held(text: Column, patterns: dict[str, str]) -> list[Column]:
    return [F.when(text.rlike(p), F.lit(fact)) for fact, p in patterns.items()]


def values(text: Column, kinds: list[str] | None = None) -> Column:
    """Distinct facts that name one thing: addresses, names, ports, paths, ... in lower case."""
    low = _low(text)
    marked = lambda kind: lambda v: F.concat(F.lit(f"{kind}:"), v)
    each = [F.transform(F.regexp_extract_all(low, F.lit(VALUES[k][0]), F.lit(VALUES[k][1])), marked(k)) for k in kinds or VALUES]
    return F.array_distinct(F.concat(*each))


def shown(text: Column) -> Column:
    """All facts that a piece of evidence shows, in order; as many as its text has room for."""
    low = _low(text)
    patterns = {fact: p for table in (THEMES, OUTCOMES, CONCLUSIONS) for fact, (_, p) in table.items()} | OTHERS
    return F.array_sort(F.array_union(F.array_compact(F.array(*_held(low, patterns))), values(text)))


def needed(text: Column) -> Column:
    """The facts that a claim needs: themes and things it speaks of, conclusions and outcomes that it asserts. What it denies, it doesn't assert."""
    low = _low(text)
    asserted = F.regexp_replace(low, NEGATED, " ")
    said = _held(asserted, {fact: said for table in (THEMES, CONCLUSIONS) for fact, (said, _) in table.items()} | {fact: said + _SEEN for fact, (said, _) in OUTCOMES.items()})
    return F.array_union(F.array_compact(F.array(*said)), values(text))


#: Kinds of facts that say which events a count is of.
_POPULATION = ["ip", "user", "process"]


def population(text: Column) -> Column:
    """The facts of the events that a claim counts: an outcome, or else a theme, and addresses, users and processes. Without an outcome or theme all of them are meant."""
    low = _low(text)
    outcome = F.coalesce(*_held(low, {fact: said for fact, (said, _) in OUTCOMES.items()}), *_held(low, {k: THEMES[k][0] for k in ("theme:authentication", "theme:process")}))
    return F.array_sort(F.array_union(F.array_compact(F.array(outcome)), values(text, _POPULATION)))


def key(evidence_id: Column) -> Column:
    """An identifier in capitals and without leading zeros, so that ``evid-7`` is ``EVID-007``."""
    return F.regexp_replace(F.upper(F.trim(evidence_id)), r"-0+(?=\d)", "-")


def sizes(populations: DataFrame, facts: DataFrame) -> DataFrame:
    """population, found: how many rows of facts (facts: array) hold all facts of each distinct population (population: array).

    A population is looked up by the rarest of its facts, so that one which names an address never meets all failures.
    """
    wanted = written(populations.select("population").distinct(), "populations")
    named = written(wanted.select("population", F.explode("population").alias("fact")), "named")
    # equal rows are one with a number, before anything is shuffled by fact
    classes = written(facts.groupBy("facts").agg(F.count("*").alias("n")), "classes")
    held = classes.select("facts", "n", F.explode("facts").alias("fact")).join(named.select("fact").distinct(), "fact", "left_semi")
    often = held.groupBy("fact").agg(F.sum("n").alias("often"))
    rarest = named.join(often, "fact", "left").groupBy("population").agg(F.min_by("fact", F.struct(F.coalesce("often", F.lit(0)), F.col("fact"))).alias("fact"))
    met = held.join(rarest, "fact").where(F.size(F.array_except("population", "facts")) == 0).groupBy("population").agg(F.sum("n").alias("found"))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    return wanted.join(met, "population", "left").join(F.broadcast(total)).select("population", F.when(F.size("population") == 0, F.col("all")).otherwise(F.coalesce("found", F.lit(0))).alias("found"))  # total is one row


def _numbers(claims: DataFrame, facts: DataFrame, counts: DataFrame | None) -> DataFrame:
    """claim, wrong, why: claims whose number, or whose "all", is not what was counted."""
    read = claims.select("claim", F.regexp_extract(F.col("low"), COUNTED, 1).try_cast("long").alias("stated"), population("low").alias("population"), F.col("low").rlike(ALL).alias("every"))
    counting = read.where(F.col("stated").isNotNull() | F.col("every"))
    both = written(counting.withColumn("broad", F.filter("population", lambda f: ~f.startswith("user:") & ~f.startswith("process:"))), "counting")
    every = both.where(F.col("every") & (F.size("population") > F.size("broad")) & (F.size("broad") > 0))
    numbers = both.where("stated IS NOT NULL")
    asked = every.select("population").union(every.select("broad"))
    found = written(sizes(asked if counts is not None else asked.union(numbers.select("population")), facts), "sizes")
    wider = found.select(F.col("population").alias("broad"), F.col("found").alias("of"))
    told = lambda wrong, text, *names: ["claim", wrong.alias("wrong"), F.format_string(text, *names).alias("why")]
    rows = every.join(found, "population").join(wider, "broad").where("of > 0").select(*told(F.col("found") != F.col("of"), "universal claim: true of %d of %d", "found", "of"))
    if counts is None:
        counted = numbers.join(found, "population").where("found > 0")
        rows = rows.unionByName(counted.select(*told(F.col("found") != F.col("stated"), "aggregate count: claim says %d, evidence has %d", "stated", "found")))
    else:
        # a count fits a claim about the same outcome, addresses, users and processes
        exact = lambda facts: F.array_sort(F.filter(facts, lambda f: F.substring_index(f, ":", 1).isin("outcome", *_POPULATION)))
        queries = counts.select("query", exact(F.array_union(population(F.col("query")), shown(F.col("query")))).alias("same"), F.col("n").cast("long").alias("n"))
        queries = queries.where((F.size("same") > 0) | (F.trim("query") == "")).select("same", "n").distinct()
        fits = numbers.withColumn("same", exact(F.col("population"))).join(queries, "same").groupBy("claim", "stated").agg(F.max(F.col("n") == F.col("stated")).alias("right"), F.min("n").alias("n"))
        rows = rows.unionByName(fits.select(*told(~F.col("right"), "contradicted by a deterministic full-dataset query: claim says %d, it counts %d", "stated", "n")))
    return rows.groupBy("claim").agg(F.max("wrong").alias("wrong"), F.min(F.when(F.col("wrong"), F.col("why"))).alias("why"))


def judge(claims: DataFrame, evidence: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """claim, verdict, status, reason, missing (the facts that no cited evidence shows, in order) and cited (how many).

    claims: claim (distinct), text, kind (what the claim wants to be, may be null), cited (array of evidence ids, may be null).
    evidence: evidence_id (distinct), text. counts: query, n of counts over all rows; they then stand for numbers in place of the evidence,
    which may be a part of the rows only. A query is understood by its outcome, addresses, users and processes; one without any, unless blank, is passed over.

    The first that holds decides: an unknown citation (UNSUPPORTED_CLAIM), advice (RECOMMENDATION), no citation, a wrong number or
    "all" (UNSUPPORTED_CLAIM), evidence of the opposite (CONTRADICTED_CLAIM), too little context (INSUFFICIENT_CONTEXT), facts that are
    missing or that are said to be many and shown once (UNSUPPORTED_CLAIM); what is left is a HYPOTHESIS, GROUNDED_INTERPRETATION or VERIFIED_FACT.
    """
    base = claims.select("claim", _low(F.col("text")).alias("low"), F.upper(F.trim(F.coalesce("kind", F.lit("")))).alias("kind"), F.coalesce("cited", F.array().cast("array<string>")).alias("ids"))
    base = written(base.withColumn("needs", needed(F.col("low"))), "claims")
    facts = written(evidence.select(key(F.col("evidence_id")).alias("id"), shown(F.col("text")).alias("facts")), "facts")
    wants = F.array_union("needs", F.array_compact(F.array(F.lit("shows:many"), *(F.when(F.array_contains("needs", a), F.lit(b)) for a, b in OPPOSITES.items()))))
    cited = base.select("claim", wants.alias("wants"), F.explode(F.array_distinct(F.transform("ids", key))).alias("id"))
    met = written(cited.join(facts, "id", "left").select("claim", "id", F.array_intersect("wants", "facts").alias("hits")), "met")
    refs = met.groupBy("claim").agg(F.count("*").alias("cited"), F.count_if(F.col("hits").isNull()).alias("unknown"))
    # one row for each claim and fact: as many as the claim's own text has facts
    shows = met.select("claim", F.explode("hits").alias("fact")).groupBy("claim", "fact").agg(F.count("*").alias("n"))
    shows = shows.groupBy("claim").agg(F.array_sort(F.collect_list("fact")).alias("has"), F.collect_list(F.when((F.col("n") > 1) & F.col("fact").startswith("theme:"), F.col("fact"))).alias("twice"))
    none = F.array().cast("array<string>")
    rows = base.join(refs, "claim", "left").join(shows, "claim", "left").join(_numbers(base, facts, counts), "claim", "left")
    rows = rows.select("claim", "low", "kind", "needs", "why", F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("unknown", F.lit(0)).alias("unknown"), F.coalesce("wrong", F.lit(False)).alias("wrong"), F.coalesce("has", none).alias("has"), F.coalesce("twice", none).alias("twice"))
    missing = F.array_sort(F.array_except("needs", "has"))
    against = [F.array_contains("needs", a) & F.array_contains("has", b) & ~F.array_contains("has", a) for a, b in OPPOSITES.items()]
    contradicted = against[0]
    for c in against[1:]:
        contradicted = contradicted | c
    spoken = F.filter("needs", lambda f: f.startswith("theme:"))
    once = F.col("low").rlike(MANY) & (F.size(spoken) > 0) & (F.size(F.array_intersect(spoken, F.col("twice"))) == 0) & ~F.array_contains("has", "shows:many")
    unsupported = lambda reason: F.struct(F.lit("UNSUPPORTED_CLAIM").alias("verdict"), F.lit("REJECTED").alias("status"), reason.alias("reason"))
    of = lambda verdict, status, reason: F.struct(F.lit(verdict).alias("verdict"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    lacks = F.array_contains(missing, "link:cause")
    result = (
        F.when(F.col("unknown") > 0, unsupported(F.lit("Unknown evidence reference")))
        .when(F.col("kind").isin("RECOMMENDATION", "RECOMMENDED_ACTION", "NEXT_STEP") | F.col("low").rlike(ADVICE), of("RECOMMENDATION", "ACCEPTED", "advice, not a finding"))
        .when(F.col("cited") == 0, unsupported(F.lit("no evidence is cited")))
        .when(F.col("wrong"), unsupported(F.col("why")))
        .when(contradicted, of("CONTRADICTED_CLAIM", "REJECTED_CONTRADICTED", "the cited evidence shows the opposite"))
        .when((F.col("kind") == "INSUFFICIENT_CONTEXT") | F.col("low").rlike(OPEN), of("INSUFFICIENT_CONTEXT", "REVIEW_REQUIRED", "the evidence doesn't settle what this means"))
        .when((F.size(missing) == 1) & lacks, unsupported(F.lit("causal claim: nothing in the cited evidence links the events; nearness in time is no cause")))
        .when(F.size(missing) > 0, unsupported(F.concat(F.lit("not in the cited evidence: "), F.array_join(missing, ", "))))
        .when(once, unsupported(F.lit("said to be repeated, but shown once")))
        .when(F.col("kind").isin("HYPOTHESIS", "POSSIBLE_EXPLANATION", "THEORY"), of("HYPOTHESIS", "ACCEPTED_AS_INTERPRETATION", ""))
        .when(F.col("kind").isin("GROUNDED_INTERPRETATION", "INTERPRETATION", "INFERENCE") | F.col("low").rlike(HEDGED), of("GROUNDED_INTERPRETATION", "ACCEPTED_AS_INTERPRETATION", ""))
        .otherwise(of("VERIFIED_FACT", "ACCEPTED", ""))
    )
    return rows.select("claim", result.alias("r"), missing.alias("missing"), "cited").select("claim", "r.verdict", "r.status", "r.reason", "missing", "cited")
