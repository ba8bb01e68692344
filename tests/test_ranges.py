"""Files read by byte ranges, cut everywhere, against plain readers."""

import csv
import io
import json
import random

import pytest

from riskloom.sources import corpus, ranges


def commits_by_ranges(raw, step):
    """What `read_commits` does, range by range in this process."""
    cuts = [{"start": a, "raw": raw[a:a + step]} for a in range(0, max(1, len(raw)), step)]
    summed = [{"start": c["start"], **dict(zip(ranges._STATE, ranges.summarise_json(c["raw"])))} for c in cuts]
    items, summaries = [], []
    for cut, (start, *state) in zip(cuts, ranges.json_states(summed), strict=True):
        for kind, repo, commit, repo_name, commit_name, text, begins, ends in ranges.json_items(cut["raw"], *state):
            if kind == "range":
                summaries.append({"start": start, "repo": repo, "commit": commit, "repo_name": repo_name,
                                  "commit_name": commit_name, "text": text})
            else:
                items.append((start, repo, commit, repo_name, commit_name, text, begins, ends))
    at = {start: rest for start, *rest in ranges.json_starts(summaries)}
    out = {}
    for start, repo, commit, repo_name, commit_name, text, begins, ends in items:
        at_repo, at_commit, in_repo, in_commit = at[start]
        names = [json.loads(b'"' + n + b'"') if n is not None else carried
                 for n, carried in ((repo_name, in_repo), (commit_name, in_commit))]
        key = at_repo + repo, commit + (at_commit if repo == 0 else 0)
        assert (key in out) != begins
        if begins:
            out[key] = [*names, b""]
        out[key][2] += text
    return [(r, a, c, b, json.loads(text)) for (r, c), (a, b, text) in sorted(out.items())]


def plain_commits(doc):
    return [(i, repo, j, commit, value) for i, (repo, commits) in enumerate(doc.items())
            for j, (commit, value) in enumerate(commits.items())]


def random_text(rng):
    return "".join(rng.choice('ab"\\{}[]:, \n\té日😀/') for _ in range(rng.randint(0, 8)))


def random_document(rng):
    def value(depth):
        pick = rng.random()
        if depth > 3 or pick < 0.4:
            return rng.choice([random_text(rng), 1, None, True])
        inner = [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return inner if pick < 0.7 else {random_text(rng) + str(i): v for i, v in enumerate(inner)}
    return {random_text(rng) + str(i): {random_text(rng) + str(j): {"files": value(1)} if rng.random() < 0.8 else [value(1)]
                                        for j in range(rng.randint(0, 3))} for i in range(rng.randint(0, 3))}


@pytest.mark.parametrize("seed", range(6))
def test_commits_of_random_documents_cut_at_every_byte(seed):
    rng = random.Random(seed)
    for _ in range(8):
        doc = random_document(rng)
        raw = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode()
        for step in [*range(1, min(len(raw), 90) + 1), len(raw) + 1]:
            assert commits_by_ranges(raw, step) == plain_commits(doc)


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_commits_are_cut_out_of_any_document(step):
    doc = {"r/1": {"c1": {"files": {"a\"}{": {"changes": [{"badparts": ["x\\", "}]"], "goodparts": []}]}}}, "c2": {}},
           "é\u2028": {"c\n3": {"files": {}, "n": [1, [2]]}}, "none": {}}
    assert commits_by_ranges(json.dumps(doc, ensure_ascii=False).encode(), step) == plain_commits(doc)


def test_backslashes_at_the_ends_of_ranges():
    doc = {'r"\\\\': {"\\" * n + '"': {"a": "\\" * n + '"{['} for n in range(6)}}
    raw = json.dumps(doc).encode()
    for step in range(1, len(raw) + 1):
        assert commits_by_ranges(raw, step) == plain_commits(doc)
    assert commits_by_ranges(b"", 4) == [] == commits_by_ranges(b"{}", 1)


@pytest.mark.parametrize("step", [7, 300, 1 << 20])
def test_commits_on_spark(spark, tmp_path, step, caplog):
    rng = random.Random(3)
    docs = {name: random_document(rng) for name in ("sql", "xss", "command_injection")}
    docs["sql"]["last"] = {"c": {"files": "x" * 500}}
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "other.json").write_text("{}")
    rows = corpus.read_diff_corpus(spark, str(tmp_path), [*docs, "absent"], step=step)
    got = sorted((r["source_category"], r["repo_pos"], r["repo"], r["commit_pos"], r["commit"], r["doc"].toPython())
                 for r in rows.collect())
    assert [g[:5] for g in got] == sorted((n, *c[:4]) for n, doc in docs.items() for c in plain_commits(doc))
    assert {g[:5]: g[5] for g in got} == {(n, *c[:4]): c[4] for n, doc in docs.items() for c in plain_commits(doc)}
    assert "absent" in caplog.text and "xss" not in caplog.text


def random_rows(rng, n):
    pieces = ["a", "b c", '"', "\n", "\r\n", ",", "''", "é", "", "def f():\n    return \"x\"\n", "#"]
    return [["".join(rng.choices(pieces, k=rng.randint(1, 6))) + "z", rng.choice(["py", "c", "Other"]),
             rng.choice(["safe", "vulnerable"])] for _ in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_cut_at_every_byte(tmp_path, end):
    rows = [["code", "language", "safety"], *random_rows(random.Random(4), 12)]
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    for tail in (end, ""):
        raw = (out.getvalue().removesuffix(end) + tail).encode()
        path = tmp_path / "a.csv"
        path.write_bytes(raw)
        for step in range(1, len(raw) + 2):
            cuts = range(0, len(raw), step)
            summed = [dict(zip(("start", "quotes", "even", "odd", "first"), (a, *ranges.summarise_csv(raw[a:a + step])))) for a in cuts]
            found = [record for start, *state in ranges.csv_starts(summed)
                     for record in ranges.csv_records(f"file:{path}", start, step, *state, step)]
            assert [n for n, _ in found] == list(range(len(rows)))
            want = [[c.replace("\r\n", "\n") if end == "\r\n" else c for c in row] for row in rows]
            assert [next(csv.reader(io.StringIO(text.decode(), newline=""))) for _, text in found] == want


@pytest.mark.parametrize("step", [50, 1 << 20])
def test_labelled_rows_equal_those_of_one_task(spark, tmp_path, step):
    rows = random_rows(random.Random(9), 60)
    for end in ("\n", "\r\n"):
        path = tmp_path / f"{len(end)}.csv"
        with open(path, "w", newline="") as file:
            writer = csv.writer(file, lineterminator=end)
            writer.writerows([["code", "language", "safety"], *rows])
            file.write(f',"",safe{end}"only"{end}a,b,c,d{end}')
        got, want = ([tuple(r) for r in corpus.read_labelled_corpus(spark, str(path), **more).orderBy("ord").collect()]
                     for more in ({"step": step}, {"by_ranges": False}))
        assert got == want and len(got) == 63


def test_several_csv_files_and_an_empty_one(spark, tmp_path):
    for name, code in (("b.csv", "two"), ("a.csv", "one")):
        (tmp_path / name).write_text(f"code,language,safety\n{code},py,safe\n")
    (tmp_path / "c.csv").write_text("")
    rows = corpus.read_labelled_corpus(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r["code"] for r in rows] == ["one", "two"] and rows[0]["ord"] == 0
