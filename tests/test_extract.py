"""Rules, lines, stitched calls and evidence, on hand-written files and against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from modelbom.functions.rules import RULES, Rule
from modelbom.functions.text import classify_file
from modelbom.operators import extract as ex


def scan(spark, files):
    df = spark.createDataFrame(files, "path string, content string")
    return ex.scan_references(df)


def ids(spark, path, content):
    return sorted(r.id for r in scan(spark, [(path, content)]).collect())


# One file per row, so that all cases run in one job.
CASES = [
    ("a.py", 'm = AutoModel.from_pretrained("bert-base-uncased")', ["bert-base-uncased"]),
    ("b.py", "AutoModel.from_pretrained(pretrained_model_name_or_path='org/m')", ["org/m"]),
    ("c.py", 'pipeline("text-generation", "gpt2")', ["gpt2"]),
    ("d.py", 'pipeline("t", model="facebook/opt-1.3b")', ["facebook/opt-1.3b"]),
    ("e.py", 'hf_hub_download(repo_id="o/r", filename="f")', ["o/r"]),
    ("f.py", 'snapshot_download("o/s")', ["o/s"]),
    ("g.py", 'InferenceClient(model="o/i")', ["o/i"]),
    ("h.py", 'InferenceApi("o/api")', ["o/api"]),
    ("i.py", 'SentenceTransformer("all-MiniLM")\nCrossEncoder("ce/x")', ["all-MiniLM", "ce/x"]),
    ("j.py", 'HuggingFaceHub(repo_id="l/hub")\nHuggingFaceEndpoint(repo_id="l/end")', ["l/end", "l/hub"]),
    ("k.py", 'HuggingFacePipeline.from_model_id(model_id="l/p", task="t")', ["l/p"]),
    ("l.py", 'evaluate.load("accuracy")\nevaluate.load("org/metric")', ["org/metric"]),
    ("m.py", 'x = 1\ny = foo(\n  model = "o/multi",\n)\nz = dict(model="plain")', ["o/multi"]),
    ("n.py", 'pipeline(\n  "t",\n  model=\n  "single",\n)', ["single"]),
    ("o.py", 'AutoModel.from_pretrained("1.0")\nAutoModel.from_pretrained("./local")', []),
    ("p.yaml", "model: org/y  # note\nmodel_name: plain\n  base_model: 'o/q'\nmodel: o/x extra", ["o/q", "org/y"]),
    ("q.json", '{"_name_or_path": "solo", "model": "o/j", "base_model": "noslash"}', ["o/j", "solo"]),
    ("r.md", "---\nbase_model: o/front\nother: o/none\n---\nSee o/body.", ["o/body", "o/front"]),
    ("s.md", "---\nmodel: o/open\nSee o/unseen", ["o/open"]),
    ("t.rst", "text o/prose and x", ["o/prose"]),
    ("u.sh", "huggingface-cli download o/cli\nexport HF_MODEL='o/env'", ["o/cli", "o/env"]),
    ("sub/Dockerfile", "ENV MODEL_ID=o/docker", ["o/docker"]),
    ("v.tsx", "pipeline('t', 'o/js'); x.from_pretrained('js1'); run({ model: \"o/f\" })", ["js1", "o/f", "o/js"]),
    ("node_modules/x.py", 'from_pretrained("o/skipped")\nx.from_pretrained("o/skipped")', []),
    ("w.txt", 'x.from_pretrained("o/unknown")', []),
    ("y.ipynb", '{"cells":[{"cell_type":"code","source":["f(\\n","  model=\\"o/nb\\")"]},{"cell_type":"markdown","source":"model: o/md"},{"cell_type":"raw","source":"model=\'o/raw\'"}]}', ["o/md", "o/nb"]),
    ("z.ipynb", 'not json x.from_pretrained("o/broken")', ["o/broken"]),
    ("za.ipynb", '[{"source": "x.from_pretrained(\'o/list\')"}]', ["o/list"]),
    ("zb.py", 'éfrom x import y\nmodel="é/x"\nx = émodel="o/ascii"', ["o/ascii"]),
]


def test_rules(spark):
    found = scan(spark, [(f"c{i}/{p}", c) for i, (p, c, _) in enumerate(CASES)])
    # Ids are distinct over the cases, so the first path tells the case.
    got = {}
    for r in found.collect():
        got.setdefault(r.path, []).append(r.id)
    want = {f"c{i}/{p}": w for i, (p, _, w) in enumerate(CASES) if w}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_rule_counts():
    kinds = [r.kind for r in RULES]
    assert len(RULES) == 33
    assert [kinds.count(k) for k in ("code", "yaml", "json", "front", "body", "shell", "js")] == [20, 1, 5, 1, 1, 2, 3]


def test_evidence_is_folded(spark):
    files = [
        ("a.py", 'pipeline(\n "t", model="o/m")\n'),
        ("b.py", 'pipeline(\n "t", model="o/m")\nx = 1\nmodel="o/m"'),
        ("c.py", '\nmodel="o/m" + x'),
    ]
    (row,) = scan(spark, files).collect()
    assert row.path == "a.py" and row.method == "model_kwarg_slash"
    seen = ex.evidence_rows(ex.scan_hits(spark.createDataFrame(files, "path string, content string")))
    assert row.evidence_texts == seen.count() and row.evidence_chars == sum(len(r.evidence) for r in seen.collect())
    (joined,) = ex.joined_evidence(seen).collect()
    assert joined.evidence.split(". ") == [
        'model_kwarg_slash at line 2: "t", model="o/m")',
        'pipeline_model_kwarg at line 1: pipeline( "t", model="o/m")',
        'model_kwarg_slash at line 1: pipeline( "t", model="o/m")',
        'model_kwarg_slash at line 4: model="o/m"',
        'model_kwarg_slash at line 2: model="o/m" + x',
    ]


def test_hot_reference_keeps_all_evidence(spark):
    """One form at every size: one row for the reference, a row for each of its texts."""
    for n in (10, 20_000):
        files = spark.range(n).selectExpr("concat('f', lpad(id, 6, '0'), '.py') AS path", "concat('x', id, ' = f(model=\"o/hot\")') AS content")
        hits = ex.scan_hits(files)
        (row,) = ex.dedupe_discoveries(hits).collect()
        assert (row.id, row.path, row.evidence_texts) == ("o/hot", "f000000.py", n)
        assert ex.evidence_rows(hits).count() == n


def test_custom_rules(spark):
    rules = [Rule("code", "load", r"\bload_it\(\s*'([a-z/]+)'")]
    df = spark.createDataFrame([("a.py", "load_it( 'x/y')\nreload_it('no')")], "path string, content string")
    assert [(r.id, r.method) for r in ex.scan_references(df, rules).collect()] == [("x/y", "load")]


def test_classes(spark):
    names = {
        "A.PY": "python", "x/Dockerfile.dev": "shell", "docker-compose.yml": "yaml", "docker-compose": "shell",
        "Containerfile": "shell", "a.mjs": "js", "requirements.txt": "unknown", "x.py/readme": "unknown", "dockerfile.py": "python",
    }
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r.path: r.c for r in df.select("path", classify_file("path").alias("c")).collect()} == names


# ---- brute force ------------------------------------------------------------------------


def brute_calls(content):
    """The line loop, one line after the other."""
    lines = content.split("\n")
    if lines[-1] == "":
        lines.pop()
    out, buf, start, depth = [], [], 0, 0
    for n, line in enumerate(lines, 1):
        line = line[:-1] if line.endswith("\r") else line
        depth = max(depth + line.count("(") - line.count(")"), 0)
        if depth or buf:
            start = start if buf else n
            buf.append(line.strip())
        if depth == 0 and buf:
            out.append((start, n, " ".join(buf)))
            buf = []
    return out


def test_stitched_calls_equal_the_line_loop(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("(()) \n\n\ra") for _ in range(rng.randrange(60))) for _ in range(1500)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    got = {}
    for r in ex.stitch_calls(df).collect():
        got.setdefault(int(r.path), []).append((r.start_line, r.end_line, r.text))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == brute_calls(t), repr(t)


def brute_hits(content):
    """Hits of the code rules in one Python file, in order."""
    lines = [l[:-1] if l.endswith("\r") else l for l in content.split("\n")]
    if lines[-1] == "":
        lines.pop()
    events = [(n, 0, n, l) for n, l in enumerate(lines, 1)] + [(e, 1, s, t) for s, e, t in brute_calls(content)]
    out = []
    for _, _, n, text in sorted(events, key=lambda e: e[:2]):
        for rule in RULES:
            if rule.kind == "code":
                for m in re.finditer(rule.pattern, text, re.ASCII):
                    out.append((m.group(1), f"{rule.method} at line {n}: {text.strip()}"))
    return out


def test_hits_equal_the_line_loop(spark):
    rng = random.Random(9)
    words = ["pipeline(", "model=", "model =", "repo_id", " = ", '"o/m"', "'x'", ",", ")", "(", "\n", "\n ", ".from_pretrained(", "hf_hub_download(", "evaluate.load(", "SentenceTransformer(", " ", "a", "_"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(25))) for _ in range(3000)]
    texts = [t for t in texts if t]
    df = spark.createDataFrame([(f"{i}.py", t) for i, t in enumerate(texts)], "path string, content string")
    rows = ex.scan_hits(df).orderBy(*ex.HIT_ORDER).collect()
    got = {}
    for r in rows:
        got.setdefault(r.path, []).append((r.id, r.evidence))
    n = 0
    for i, t in enumerate(texts):
        # Single letters are no plausible ids.
        want = [h for h in brute_hits(t) if len(h[0]) > 1]
        assert got.get(f"{i}.py", []) == want, repr(t)
        n += len(want)
    assert n > 300


@pytest.mark.parametrize("close", ["---", "..."])
def test_front_matter_delimiters(spark, close):
    assert ids(spark, "x.md", f" --- \nmodel: o/a\n{close}\nmodel: o/b") == ["o/a", "o/b"]


def test_huge_file_with_calls(spark):
    """200,000 lines with 100,000 calls over two lines: each call row holds its own lines, in time that grows with the lines."""
    import time

    n = 200_000
    text = "\n".join(f'm{k} = x.from_pretrained(\n  "org/m{k}")' for k in range(n // 2))
    took = []
    for lines in (n // 4, n):
        part = spark.createDataFrame([("a.py", "\n".join(text.split("\n")[:lines]))], "path string, content string")
        start = time.time()
        rows = ex.stitch_calls(part).agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"), F.max("end_line").alias("last")).first()
        took.append(time.time() - start)
        assert (rows["n"], rows["last"]) == (lines // 2, lines) and rows["longest"] < 80
    assert took[1] < 12 * took[0] + 5


def evidence_of(spark, texts):
    rows = [("model", i, e, (f"p{k:06d}", 0, 1, 0, 0, 0, "m")) for k, (i, e) in enumerate(dict.fromkeys(texts))]
    at = "struct<path:string,cell:int,emit_line:int,phase:int,rule_ord:int,match_ord:int,method:string>"
    return spark.createDataFrame(rows, f"type string, id string, evidence string, at {at}")


def plain_joined(texts):
    out = {}
    for i, e in dict.fromkeys(texts):
        if i not in out:
            out[i] = e
        elif e not in out[i]:
            out[i] += ". " + e
    return out


@pytest.mark.parametrize("seed", range(4))
def test_evidence_containment(spark, seed):
    """Texts that lie in others, at their start, in quoted evidence, and across the joint of two."""
    rnd = random.Random(seed)
    words = ["a", "ab", "b. a", "b.", ". ", "load at line 2: a", "at line 1: ab", "x"]

    def text():
        return f"{rnd.choice(['load', 'preload', 'x.load'])} at line {rnd.randrange(1, 3)}: {' '.join(rnd.choice(words) for _ in range(rnd.randrange(1, 4)))}"

    texts = [(f"i{rnd.randrange(6)}", text()) for _ in range(250)]
    quoted = [(i, f"{t}. {u}"[: rnd.randrange(12, 80)]) for (i, t), (_, u) in zip(texts[::9], texts[1::9])]
    texts += [(i, t) for i, t in quoted if " at line " in t and ": " in t]
    rnd.shuffle(texts)
    texts += [("no mark", "a"), ("no mark", "b"), ("no mark", "a. b"), ("one", "load at line 1: z")]
    got = {r["id"]: r["evidence"] for r in ex.joined_evidence(evidence_of(spark, texts)).collect()}
    assert got == plain_joined(texts)


def test_evidence_of_a_hot_reference_stays_spread(spark):
    """200,000 texts of one reference: none is gathered, and repeats with longer tails are dropped."""
    n = 200_000
    at = F.struct(F.format_string("p%06d", "id").alias("path"), *[F.lit(0).alias(c) for c in ("cell", "emit_line", "phase", "rule_ord", "match_ord")], F.lit("m").alias("method"))
    tail = F.when(F.col("id") % 2 == 0, F.concat(F.lit("name = 'org/hot' # "), (F.col("id") + 1).cast("string"), F.lit(" and more"))).otherwise(F.concat(F.lit("name = 'org/hot' # "), F.col("id").cast("string")))
    rows = spark.range(n).select(F.lit("model").alias("type"), F.lit("org/hot").alias("id"), F.concat(F.lit("load at line "), (F.floor(F.col("id") / 2) % 5000).cast("string"), F.lit(": "), tail).alias("evidence"), at.alias("at"))
    kept = ex.kept_evidence(rows)
    assert kept.count() == n // 2
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1  # of the folded references alone, of which there is none here
