from docloom.operators import workflows as W

FILE = b"""jobs:
  a:
    steps:
      - uses: actions/checkout@abc # v4.1.0
        with:
          version: 1.2.3
      - uses: ./local@x # v1
      - uses: actions/cache@def # v3
      - run: x
        version: 9
      - uses: plain@v1
      - uses: a/b/c@v1 # v1
      - uses: a/bare@v1
"""


def test_inventory(spark):
    files = spark.createDataFrame([("w/a.yml", bytearray(FILE)), ("w/b.yaml", bytearray(FILE.replace(b"abc", b"zzz"))), ("c.txt", bytearray(FILE))], "path string, bytes binary")
    lines = W.workflow_lines(files)
    uses = W.used_actions(lines)
    assert {(r["path"], r["line_index"], r["action"], r["ref"], r["version"]) for r in uses.collect()} == {
        (p, i, a, ref if p == "w/a.yml" or a != "actions/checkout" else "zzz", v)
        for p in ("w/a.yml", "w/b.yaml")
        for i, a, ref, v in ((3, "actions/checkout", "abc", "4.1.0"), (7, "actions/cache", "def", "3"))
    }
    groups = {(r["action"], r["version"]): (r["ref"], len(r["occurrences"])) for r in W.action_groups(uses).collect()}
    assert groups == {("actions/checkout", "4.1.0"): ("abc", 2), ("actions/cache", "3"): ("def", 2)}
    inputs = W.input_lines(lines, uses, "version").where("path = 'w/a.yml'").collect()
    assert {(r["action"], r["line_index"], r["value"]) for r in inputs} >= {("actions/checkout", 5, "1.2.3")}
    tags = spark.createDataFrame([("actions/cache", "v3", "def"), ("actions/cache", "v10.0.1", "new"), ("actions/cache", "v11.0.0-rc", "rc")], "action string, tag string, commit string")
    new = W.rewritten_lines(uses, W.newest_tags(tags)).collect()
    assert {r["line"] for r in new} == {"      - uses: actions/cache@new # v10.0.1"} and len(new) == 2
    report = {r["action"]: tuple(r)[1:] for r in W.update_report(uses, W.newest_tags(tags)).collect()}
    assert report == {"actions/cache": ("3", "def", "10.0.1", "new", True), "actions/checkout": ("4.1.0", "abc", None, None, False)}


def test_inputs_take_one_pass_over_long_files(spark):
    """Values behind a line that is indented less are another step's; frames that shrink would be quadratic in a file's lines."""
    text = "      - uses: a/b@r # v1\n          version: 1.2.%d\n      - uses: a/c@r # v1\n    x:\n          version: 9.9.9\n"
    many = "".join(text % i for i in range(300)) + "      - uses: a/b@r # v1\n"
    lines = W.workflow_lines(spark.createDataFrame([("w/a.yml", bytearray(many, "utf8")), ("w/b.yml", bytearray(FILE))], "path string, bytes binary"))
    found = W.input_lines(lines, W.used_actions(lines), "version")
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
    got = {(r["action"], r["use_line"], r["line_index"], r["value"]) for r in found.where("path = 'w/a.yml'").collect()}
    assert got == {("a/b", 5 * i, 5 * i + 1, f"1.2.{i}") for i in range(300)}
