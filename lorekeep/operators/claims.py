"""Claims that memories make about pull and merge requests, and their contradictions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLAIM = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "ref", "state", "evidence")]))

# The patterns that claims are recognised by, and the reach around a reference.
URL = re.compile(r"https?://(?:www\.)?(?:github|gitlab)\.com/([\w.-]+(?:/[\w.-]+)*?)/(?:pull|-/merge_requests|merge_requests)/(\d+)", re.I)
REFERENCE = re.compile(r"\b(?P<kind>PR|MR|pull request|merge request)\s*[#!]?(?P<num>\d+)")
REPO_BEFORE = re.compile(r"(?<![\w.-])([A-Za-z][\w.-]{2,30})\s+$")
RESOLVED = re.compile(r"(?<!not )(?<!not yet )(?<!never )(?<!isn't )(?<!wasn't )\b(?:merged|landed|released|closed|abandoned|deleted)\b", re.I)
OPEN = re.compile(r"\b(?:open|opened|awaiting|pending|unmerged|(?:not\s+(?:yet\s+)?|never\s+)merged|held|in\s+review|needs\s+(?:review|merge)|still\s+open)\b", re.I)
WIKI_LINK = re.compile(r"\[\[.*?\]\]", re.S)
BEFORE, AFTER, EVIDENCE, REPO_REACH = 20, 90, 200, 48
STATE_RANK = {"unverified": 0, "open": 1, "resolved": 2}


def claims_in(text: str, default_repo: str | None, aliases: dict[str, str]) -> list[dict]:
    """One claim for each (kind, repo#number) of a text: its strongest state and the words around it."""
    text = WIKI_LINK.sub(lambda link: re.sub(r"[^\n]", " ", link[0]), text) if "[[" in text else text
    by_url: dict[str, str] = {}
    for url in URL.finditer(text) if "://" in text else ():
        by_url.setdefault(url[2], url[1].rsplit("/", 1)[-1])
    known = {a.lower(): r for a, r in aliases.items()} | ({default_repo.lower(): default_repo} if default_repo else {})
    found: dict[tuple[str, str], dict] = {}
    for ref in REFERENCE.finditer(text):
        before = REPO_BEFORE.search(text, max(0, ref.start() - REPO_REACH), ref.start())
        word = before[1].rstrip(":,.").lower() if before else ""
        repo = by_url.get(ref["num"]) or known.get(word, default_repo)
        line = text[text.rfind("\n", 0, ref.start()) + 1 : ref.start()]
        if repo is None or line.count('"') % 2 or line.count("`") % 2:
            continue
        around = text[max(0, ref.start() - BEFORE) : ref.end() + AFTER]
        state = "resolved" if RESOLVED.search(around) else "open" if OPEN.search(around) else "unverified"
        claim = {"kind": "mr" if ref["kind"][0] in "Mm" else "pr", "ref": f"{repo}#{ref['num']}", "state": state, "evidence": " ".join(around.split())[:EVIDENCE]}
        kept = found.setdefault((claim["kind"], claim["ref"]), claim)
        if STATE_RANK[state] > STATE_RANK[kept["state"]]:
            found[claim["kind"], claim["ref"]] = claim
    return list(found.values())


def extract(memories: DataFrame, repo: Column, aliases: dict[str, str] | None = None) -> DataFrame:
    """(memory_id, namespace, kind, ref, state, evidence); ``repo`` is what a bare reference means, null for none.

    Only texts that hold a digit after a reference word reach Python.
    """
    names = dict(aliases or {})

    @F.pandas_udf(CLAIM)
    def run(text: pd.Series, default: pd.Series) -> pd.Series:
        return pd.Series([claims_in(t, d, names) for t, d in zip(text, default.where(default.notna(), None), strict=True)])

    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    hopeful = memories.where(text.rlike(r"(PR|MR|pull request|merge request)\s*[#!]?\d"))
    return hopeful.select(F.col("id").alias("memory_id"), "namespace", F.explode(run(text, repo)).alias("c")).select("memory_id", "namespace", "c.*")


def default_repo(namespace: Column, given: Column) -> Column:
    """A namespace's own repo: its name unless set; set to nothing: none."""
    return F.when(given.isNull(), namespace).otherwise(F.nullif(given, F.lit("")))


def pending(claims: DataFrame) -> DataFrame:
    """``claims`` without those that were marked resolved."""
    return claims.where("resolved_state IS NULL") if "resolved_state" in claims.columns else claims


def in_mode(memories: DataFrame, claims: DataFrame, mode: str) -> DataFrame:
    """The ``memories`` with an open, an unverified or a contradicted claim (``mode``) that isn't marked resolved."""
    if mode not in ("open", "unverified", "contradicted"):
        raise ValueError(f"unknown claims mode: {mode}")
    if mode == "contradicted":
        found = contradicted(claims, memories.where("confidence <> 'deprecated'").select("id"))
    else:
        found = pending(claims).where(F.col("state") == mode)
    return memories.join(found.select(F.col("memory_id").alias("id")), "id", "left_semi")


def unresolved(claims: DataFrame) -> DataFrame:
    return claims.where("state <> 'resolved'")


def contradicted(claims: DataFrame, active: DataFrame) -> DataFrame:
    """Open claims on a reference that another active memory of the namespace says is resolved."""
    live = claims.join(active.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    done = live.where("state = 'resolved'").groupBy("namespace", "kind", "ref").agg(F.min("memory_id").alias("one"), F.max("memory_id").alias("other"))
    return pending(live).where("state = 'open'").join(done, ["namespace", "kind", "ref"]).where("one <> memory_id OR other <> memory_id").select("memory_id", "namespace", "kind", "ref", "evidence")


def backlog(claims: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, title, ref, contradicted, created_at): the open claims of active memories that wait to be resolved."""
    active = memories.where("confidence <> 'deprecated'")
    own = pending(claims).where("state = 'open'").join(active.select(F.col("id").alias("memory_id"), "title", "created_at"), "memory_id")
    key = ["memory_id", "kind", "ref"]
    against = contradicted(claims, active.select("id")).select(*key, F.lit(True).alias("against")).distinct()
    met = own.join(against, key, "left").withColumn("contradicted", F.coalesce("against", F.lit(False)))
    return met.groupBy(F.col("memory_id").alias("id"), "title", "ref", "created_at").agg(F.max("contradicted").alias("contradicted"))


def sample(claims: DataFrame, memories: DataFrame, limit: int = 5) -> DataFrame:
    """The first of the backlog, contradicted ones before others, then the oldest; 1 to 100 of them."""
    return backlog(claims, memories).orderBy(F.desc("contradicted"), "created_at", "id", "ref").limit(max(1, min(limit, 100)))


def statistics(claims: DataFrame, memories: DataFrame) -> DataFrame:
    """One row: claims by state that aren't marked resolved, the open ones of active memories, and how many of these are contradicted."""
    states = pending(claims).agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("open", "resolved", "unverified")])
    held = backlog(claims, memories).agg(F.count("*").alias("open_actionable"), F.count_if("contradicted").alias("contradicted"))
    return states.join(F.broadcast(held))


def rederived(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new claims with the resolutions of the old, and what became of each (kept, changed, added, pruned)."""
    key = ["memory_id", "kind", "ref"]
    left = old.select(*key, F.col("state").alias("old_state"), F.col("evidence").alias("old_evidence"), "resolved_state")
    both = left.join(new.select(*key, "state", "evidence"), key, "full_outer")
    change = F.when(F.col("state").isNull(), "pruned").when(F.col("old_state").isNull(), "added").when((F.col("state") != F.col("old_state")) | (F.col("evidence") != F.col("old_evidence")), "changed").otherwise("kept")
    return both.select(*key, "state", "evidence", "resolved_state", change.alias("change"))


def synchronised(old: DataFrame, moved_rows: DataFrame, moved: DataFrame, deleted: DataFrame, repo: Column, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``old`` claims (with resolved_state) brought up to date with what changed since, and (memory_id, kind, ref, change) of what did.

    ``moved_rows`` are the memories whose texts changed or are new, ``moved`` their ids and ``deleted`` those that are no more: only these are
    derived again.  A claim that a text still makes keeps its resolution.
    """
    ids = lambda df: df.select(F.col("id").alias("memory_id")).distinct()
    touched = ids(moved).union(ids(deleted)).distinct()
    rest = old.join(touched, "memory_id", "left_anti")
    before = old.join(ids(moved), "memory_id", "left_semi")
    fresh = extract(moved_rows, repo, aliases)
    told = rederived(before, fresh)
    spaces = fresh.select("memory_id", "kind", "ref", "namespace")
    new = told.where("change <> 'pruned'").join(spaces, ["memory_id", "kind", "ref"])
    names = ["memory_id", "namespace", "kind", "ref", "state", "evidence", "resolved_state"]
    return rest.select(names).unionByName(new.select(names)), told.select("memory_id", "kind", "ref", "change")


def contradicted_after(before: DataFrame, claims: DataFrame, active: DataFrame, refs: DataFrame) -> DataFrame:
    """The contradictions after a change, of which only those on the touched ``refs`` (namespace, kind, ref) are looked for.

    ``before`` are the contradictions so far; ``refs`` must hold every reference of a claim that came, went or changed, and of a memory
    that became active or ceased to be.
    """
    key = ["namespace", "kind", "ref"]
    touched = refs.select(key).distinct()
    again = contradicted(claims.join(touched, key, "left_semi"), active)
    return before.join(touched, key, "left_anti").select("memory_id", *key).unionByName(again.select("memory_id", *key))


def touched_refs(old: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """(namespace, kind, ref) of all claims that the memories ``ids`` make or made."""
    key = ["namespace", "kind", "ref"]
    own = ids.select(F.col("id").alias("memory_id")).distinct()
    return old.join(own, "memory_id", "left_semi").select(key).union(new.join(own, "memory_id", "left_semi").select(key)).distinct()


def resolve(claims: DataFrame, refs: list[str] | str, state: str = "resolved") -> DataFrame:
    """Set ``resolved_state``: on all open claims, or on the named references in whatever state."""
    hit = F.col("state") == "open" if refs == "all" else F.col("ref").isin(list(refs))
    return claims.withColumn("resolved_state", F.when(hit & F.col("resolved_state").isNull(), state).otherwise(F.col("resolved_state")))
