import pytest

from runloom.functions import commands as C

STORY = [
    ("ls -la && less tox.ini", []),
    ("printf 'x = 1\\n' > lib/zoo/cage.py", [("edit", "lib/zoo/cage.py")]),
    ("cat > /testbed/probe.py <<'STOP'\nimport zoo\nassert zoo.count() == 3\nSTOP", [("edit", "probe.py")]),
    ("timeout 60 python3 probe.py", [("verify", "")]),
    ("cat > show.py <<STOP\nimport zoo\nprint(zoo)\nSTOP\npython show.py", [("edit", "show.py")]),
    ('python3 -c "import zoo; assert zoo.count()"', [("verify", "")]),
    ("cd lib && perl -pi -e 's/lion/tiger/' zoo/names.py", [("edit", "lib/zoo/names.py")]),
    ("tox -e unit 2>&1 | tee run.log", [("verify", "")]),
    ("python3 <<'STOP'\nwith open('zoo.cfg', 'w') as f: f.write('y')\nSTOP", [("edit", "zoo.cfg")]),
    ("git log > history.txt", []),
    ("grep -rn pytest docs", []),
    ("env A=1 nosetests -v zoo > all.out", [("verify", "")]),
]


def test_events_with_memory_across_commands():
    memory = {}
    for command, want in STORY:
        assert [e[:2] for e in C.events(command, memory)] == want, command


@pytest.mark.parametrize("command", ["", "'", '"', "<<", "cat <<EOF", "a >", "&&", "a && ; | b", "\\", "cd", "timeout", "sudo -u x", "x" * 100_000, "echo '" + "a;b|c" * 1000])
def test_damaged_commands_do_not_raise(command):
    list(C.events(command, {}))


def test_quotes_hide_operators_and_wrappers_vanish():
    assert [s.words for s in C.read("echo 'a && b; c' | grep \"x|y\"")] == [["echo", "a && b; c"], ["grep", "x|y"]]
    assert C.program(["A=1", "sudo", "timeout", "-k", "5", "30s", "pytest"]) == ["pytest"]


@pytest.mark.parametrize(("output", "runner", "want"), [
    ("3 passed in 1s", "pytest", "pass"), ("returncode: 1\n1 failed, 2 passed", "pytest", "fail"), ("returncode: 2\nImportError: cannot import name 'x'\n1 error", "pytest", "error_env"),
    ("returncode: 1\nSyntaxError: bad\n1 error", "pytest", "error_code"), ("Ran 3 tests\n\nOK", "unittest", "pass"), ("Ran 3 tests\n\nFAILED (failures=1)", "unittest", "fail"),
    ("", "own script", "script_ok"), ("returncode: 1\nTraceback (most recent call last)\nAssertionError", "own script", "script_fail"), ("bash: tox: command not found", "tox", "error_env"), (None, "pytest", "unknown"), ("Command timed out", "pytest", "unknown"),
])
def test_outcomes(output, runner, want):
    assert C.outcome(output, runner) == want


def test_tool_kinds():
    assert C.tool_kind("spotify__show_song") == ("read", "spotify")
    assert C.tool_kind("venmo__approve_payment_request") == ("edit", "venmo")
    assert C.tool_kind("venmo__login")[0] is None and C.tool_kind("supervisor__complete_task")[0] is None and C.tool_kind("TodoWrite")[0] is None
    assert C.tool_kind("cancel_pending_order", "shop") == ("edit", "shop") and C.tool_kind("get_order_details", "shop")[0] == "read"


def test_events_of_runs_keep_their_own_memory(spark):
    from runloom.operators.command_runs import check_features, command_events

    rows = [("a", 0, 0, "cat > c.py <<E\nassert 1\nE", None), ("a", 1, 0, "python c.py", "returncode: 1\nAssertionError"), ("b", 0, 0, "python c.py", ""), ("b", 1, 0, "sed -i s/a/b/ x.py && pytest", "1 passed"), (None, 0, 0, "pytest", ""), ("c", 0, 0, None, "")]
    ev = command_events(spark.createDataFrame(rows, "run_id string, pos int, call_idx int, call string, output string"))
    got = sorted(tuple(r) for r in ev.select("run_id", "pos", "kind", "outcome").collect())
    assert got == [("a", 0, "edit", None), ("a", 1, "verify", "script_fail"), ("b", 1, "edit", None), ("b", 1, "verify", "pass")]
    f = {r.run_id: r for r in check_features(ev).collect()}
    assert f["a"].unresolved_fail == 1 and f["b"].unresolved_fail == 0 and f["a"].n_fail_after_edit == 1 and f["b"].last_status == "pass"
