"""Commands of runs in order, with state from one command to the next."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions import commands as C
from runloom.functions import outcomes as O

_ROWS = "run_id string, pos long, call_idx int, ev_idx int, kind string, target string, runner string, outcome string"


def command_events(calls: DataFrame) -> DataFrame:
    """(run_id, pos, call_idx, ev_idx, kind, target, runner, outcome) for calls (run_id, pos, call_idx, call, output).

    Each run's calls are read in order of pos and call_idx, as which scripts are checks depends on what the run wrote
    before. Partitions are sorted by run and streamed, so a run's calls never lie in memory together; only its memory of
    written files does. outcome is null for edits. Calls without run or text give no events.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, memory = None, {}
        for b in batches:
            rows = []
            for rid, pos, k, call, output in zip(b["run_id"], b["pos"], b["call_idx"], b["call"], b["output"]):
                if rid != run:
                    run, memory = rid, {}
                for e, (kind, target, runner) in enumerate(C.events(call, memory)):
                    rows.append((rid, pos, k, e, kind, target, runner, C.outcome(output, runner) if kind == "verify" else None))
            yield pd.DataFrame(rows, columns=["run_id", "pos", "call_idx", "ev_idx", "kind", "target", "runner", "outcome"])

    ordered = calls.where("run_id is not null and call is not null").select("run_id", F.col("pos").cast("long").alias("pos"), F.col("call_idx").cast("int").alias("call_idx"), "call", "output").repartition("run_id").sortWithinPartitions("run_id", "pos", "call_idx")
    return ordered.mapInPandas(walk, _ROWS)


def calls_with_output(steps: DataFrame) -> DataFrame:
    """(run_id, pos, call_idx, call, output) of assistant rows; output is the text of the tool row right after."""
    nxt = F.lead(F.struct("role", "text")).over(Window.partitionBy("run_id").orderBy("pos"))
    d = steps.withColumn("_n", nxt).where("role = 'assistant'")
    output = F.when(F.col("_n.role") == "tool", F.col("_n.text"))
    return d.select("run_id", "pos", F.posexplode("tool_calls").alias("call_idx", "call"), output.alias("output"))


def check_features(ev: DataFrame) -> DataFrame:
    """(run_id, n_checks, n_fail, last_status, unresolved_fail, edit_after_pass, n_fail_after_edit): what a run's own
    checks say, one row a run with any event."""
    order = F.struct("pos", "call_idx", "ev_idx")
    check = F.col("kind") == "verify"
    bad, good = F.col("outcome").isin("fail", "error_code", "script_fail"), F.col("outcome").isin("pass", "script_ok")
    w = Window.partitionBy("run_id")
    d = ev.withColumn("_o", order).withColumn("_edit", F.min(F.when(F.col("kind") == "edit", F.col("_o"))).over(w))
    g = d.groupBy("run_id").agg(
        F.count_if(check).alias("n_checks"), F.count_if(bad).alias("n_fail"), F.max_by("outcome", F.when(check, F.col("_o"))).alias("last_status"),
        F.max(F.when(good, F.col("_o"))).alias("p"), F.max(F.when(bad, F.col("_o"))).alias("f"), F.max(F.when(F.col("kind") == "edit", F.col("_o"))).alias("e"),
        F.count_if(bad & (F.col("_o") > F.col("_edit"))).alias("n_fail_after_edit"),
    )
    fail = F.col("f").isNotNull() & (F.col("p").isNull() | (F.col("f") > F.col("p")))
    return g.select("run_id", "n_checks", "n_fail", F.coalesce("last_status", F.lit("none")).alias("last_status"), fail.cast("int").alias("unresolved_fail"), F.coalesce(F.col("e") > F.col("p"), F.lit(False)).cast("int").alias("edit_after_pass"), "n_fail_after_edit")


class Run:
    """What a run did so far that later commands depend on: files it wrote, whether they assert, whether they write the
    project, and files that it created and that are not the project's code."""

    def __init__(self, repo: str):
        self.repo, self.asserts, self.writes, self.created = repo, {}, {}, set()

    def row(self, call: str, output: str | None, paired: bool) -> tuple:
        """(is_edit, is_check, is_project, runner, category, rule, kind, line, n_failed, code_edit_at, check_at)."""
        commands, cwd = C.read(call), C.ROOT
        kinds, runners, scripts, edits, code_edit, last = set(), [], [], [], -1, -1
        for k, simple in enumerate(commands):
            prog = C.program(simple.words)
            if prog[:1] == ["cd"] and len(prog) > 1:
                cwd = posixpath.normpath(posixpath.join(cwd, prog[1])) if prog[1][0] not in "~$-" else "/?"
                continue
            code = C._python_code(prog, simple.documents) if prog and re.fullmatch(r"python[\d.]*", posixpath.basename(prog[0])) else []
            for target in simple.outputs:
                if simple.documents and C.is_code(target):
                    path = C.tidy_path(target, cwd)
                    self.asserts[path] = any(re.search(r"\bassert\b", d) for d in simple.documents)
                    self.writes[path] = any(O.writes_project(d) for d in simple.documents)
            call_of = O.runner_of(prog)
            if call_of and not any(a in O.INFORMATION for a in call_of[1]):
                runners.append((k, *call_of, cwd))
            own = C._runs_tests(prog, simple.documents, cwd, self.asserts) if prog and not call_of else ""
            target = C._edits(prog, simple, cwd)
            if own in ("own script", "inline assert"):
                path = next((C.tidy_path(w, cwd) for w in prog[1:] if w.endswith(".py")), "")
                scripts.append((k, path, any(map(O.writes_project, code)) or self.writes.get(path, False)))
            elif not call_of and not own and target is not None:
                kinds.add("edit")
                edits.append(target)
            diff = bool(prog) and (prog[0] == "patch" or prog[:2] == ["git", "apply"])
            if code_edit < 0 and (diff or (target and O.is_code_file(target, self.repo))):
                code_edit = k
            if target and target != "?" and not O.is_code_file(target, self.repo):
                self.created.add(target)
            self.created.difference_update(O.reverted(prog, cwd))
        paths = {p for _, p, _ in scripts if p}
        # a script of the run's own that writes the repository is an edit, no check
        check = bool(runners) or (bool(scripts) and not any(w for _, _, w in scripts) and not any(t not in paths and t[:1] != "/" for t in edits))
        if not check:
            return "edit" in kinds, False, False, "", None, None, None, None, 0, code_edit, -1
        last = max([r[0] for r in runners] + [k for k, _, _ in scripts])
        project = any(O.is_project_run(name, args, where, self.created) for _, name, args, where in runners)
        labels = tuple(x for _, _, args, _ in runners for x in O.labels_of(args))
        about = O.Check(call, bool(runners), labels, self.repo, O.code_counts(commands, last), frozenset(self.created))
        found = O.judge(output, about) if paired else O.Outcome("unknown", "unpaired_output")
        return "edit" in kinds, True, project, runners[0][1] if runners else "", found.final(project), found.rule, found.kind or "", found.line[:200], found.n_failed, code_edit, last


_CHECKS = "run_id string, pos long, call_idx int, is_edit boolean, is_check boolean, is_project boolean, runner string, category string, rule string, kind string, line string, n_failed int, code_edit_at int, check_at int"


def paired_calls(steps: DataFrame) -> DataFrame:
    """(run_id, task_id, pos, call_idx, call, output, paired) of assistant rows: a step's outputs go with its calls, in
    order, where there are as many; else no call of the step is paired."""
    of = ["run_id", "step_idx"]
    outputs = steps.where("role = 'tool'").groupBy(*of).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("outputs"))
    calls = steps.where("role = 'assistant'").select("run_id", "step_idx", "task_id", "pos", F.posexplode("tool_calls").alias("call_idx", "call"), F.size("tool_calls").alias("_n"))
    d = calls.join(outputs, of, "left").withColumn("paired", F.coalesce(F.size("outputs") == F.col("_n"), F.lit(False)))
    return d.select("run_id", "task_id", F.col("pos").cast("long").alias("pos"), F.col("call_idx").cast("int").alias("call_idx"), "call", F.when(F.col("paired"), F.get("outputs", F.col("call_idx"))).alias("output"), "paired")


def check_rows(calls: DataFrame) -> DataFrame:
    """A row for each call of paired_calls(): whether it edits, whether it is a check and of the project, and its outcome.

    category: pass, fail, error_env, error_code, script_ok, script_fail or unknown; rule and kind say why; code_edit_at is
    the first simple command that edits the project's code, check_at the last of the check, -1 if none. Runs are streamed
    in order of pos and call_idx, with the memory of what each run wrote. Calls without run or text give no rows.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, run = None, None
        for b in batches:
            rows = []
            for rid, task, pos, k, call, output, paired in zip(b["run_id"], b["task_id"], b["pos"], b["call_idx"], b["call"], b["output"], b["paired"]):
                if rid != of:
                    of, run = rid, Run(O.repo_of(task))
                rows.append((rid, pos, k, *run.row(call, output, paired)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _CHECKS.split(", ")])

    ordered = calls.where("run_id is not null and call is not null").repartition("run_id").sortWithinPartitions("run_id", "pos", "call_idx")
    return ordered.select("run_id", "task_id", "pos", "call_idx", "call", "output", "paired").mapInPandas(walk, _CHECKS)


# fixed values: the categories of checks, those of project checks, and the merged ones
CATEGORIES = ("pass", "fail", "error_env", "error_code", "script_ok", "script_fail", "unknown")
PROJECT_CATEGORIES = ("pass", "fail", "error_env", "error_code", "unknown")
MERGED = {"pass": ("pass", "script_ok"), "fail": ("fail", "script_fail"), "error": ("error_env", "error_code"), "unknown": ("unknown",)}


def check_block(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Per run the 19 features o_ of its project checks and the 15 om_ of all its checks (o_ran_project_tests is of both).

    rows are check_rows(), claims (run_id, claim) says whether the run claims success. A check counts as failed only
    after the first edit of the project's code; contradiction: the run claims success though its last check failed.
    """
    order = F.struct("pos", "call_idx")
    first = rows.where("code_edit_at >= 0").groupBy("run_id").agg(F.min(F.struct("pos", "call_idx", "code_edit_at")).alias("edited"))
    d = rows.join(first, "run_id", "left").withColumn("_o", order)
    after = F.coalesce(F.struct("pos", "call_idx", F.col("check_at").alias("code_edit_at")) > F.col("edited"), F.lit(False))
    d = d.withColumn("_after", F.col("is_check") & after)
    sets = {
        "o": (F.col("is_check") & F.col("is_project"), ("fail", "error_env", "error_code"), ("pass",), ("fail",)),
        "om": (F.col("is_check"), MERGED["fail"] + MERGED["error"], MERGED["pass"], MERGED["fail"]),
    }
    sums = [F.max(F.when(F.col("is_edit"), F.col("_o"))).alias("last_edit"), F.count_if("is_check").alias("n_checks")]
    for x, (own, bad, good, _) in sets.items():
        failed = own & F.col("_after") & F.col("category").isin(*bad)
        sums += [
            F.max(F.when(own, F.struct("_o", "category", "n_failed"))).alias(f"{x}_last"), F.count_if(failed).alias(f"{x}_n_fail"), F.count_if(own & F.col("_after")).alias(f"{x}_after"),
            F.max(F.when(failed, F.col("_o"))).alias(f"{x}_bad"), F.max(F.when(own & F.col("category").isin(*good), F.col("_o"))).alias(f"{x}_good"),
        ]
    g = d.groupBy("run_id").agg(*sums).join(claims.select("run_id", F.col("claim").alias("_claim")), "run_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    out = [F.col("run_id"), F.col("n_checks"), flag(F.col("o_last").isNotNull()).alias("o_ran_project_tests")]
    out += [flag(F.col("om_last.category") == c).alias(f"o_last_status_{c}") for c in CATEGORIES]
    out += [flag(F.col("o_last.category") == c).alias(f"o_last_project_status_{c}") for c in PROJECT_CATEGORIES]
    for y, x in (("last_status", "om"), ("last_project_status", "o")):
        out += [flag(F.col(f"{x}_last.category").isin(*cs)).alias(f"om_{y}_{c}") for c, cs in MERGED.items()]
    for x, (_, bad, _, fails) in sets.items():
        last = F.col(f"{x}_last.category")
        out += [
            F.col(f"{x}_n_fail"),
            F.coalesce(F.try_divide(f"{x}_n_fail", f"{x}_after"), F.lit(0.0)).alias(f"{x}_share_fail"),
            flag(F.col(f"{x}_bad").isNotNull() & (F.col(f"{x}_good").isNull() | (F.col(f"{x}_bad") > F.col(f"{x}_good")))).alias(f"{x}_unresolved_fail"),
            flag(F.col("last_edit") > F.col(f"{x}_good")).alias(f"{x}_edit_after_last_pass"),
            F.when(last.isin(*fails), F.col(f"{x}_last.n_failed")).otherwise(0).alias(f"{x}_last_fail_count"),
            flag(F.col("_claim").cast("boolean") & last.isin(*bad)).alias(f"{x}_contradiction"),
        ]
    return g.select(*out)
