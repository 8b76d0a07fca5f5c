"""The command line from responses to a split training set."""

from __future__ import annotations

import json

from reasonflow.__main__ import main


def lines(folder):
    return [json.loads(x) for p in sorted(folder.glob("*.json")) for x in p.read_text().splitlines()]


def test_all_steps(spark, tmp_path):
    say = lambda n: "\n\n".join(f"This is step number {i} of the solution." for i in range(n))
    entry = lambda n, k: {"problem": "p", "ground_truth": "1", "samples": [{"response": say(n + i), "correct": True} for i in range(k)]}
    path = tmp_path / "all_records.jsonl"
    path.write_text("".join(json.dumps({"problem_id": i, "type": "t", "level": "l", "original": entry(2, 1), "simple": entry(3, 3), "hard": entry(2, 1)}) + "\n" for i in (11, 2)))
    run = lambda *a: main([str(x) for x in a], spark)
    run("segment", "--input", path, "--output", tmp_path / "seg")
    assert [s["num_steps"] for s in sorted(lines(tmp_path / "seg"), key=lambda r: r["problem_id"])[0]["simple"]["samples"]] == [3, 4, 5]
    run("requests", "--input", tmp_path / "seg", "--output", tmp_path / "req")
    asked = lines(tmp_path / "req")
    assert len(asked) == 10 and asked[0]["body"]["messages"][1]["content"].count("[") >= 2
    results = tmp_path / "results.jsonl"
    with results.open("w") as f:
        for r in asked:
            n = r["body"]["messages"][1]["content"].count("This is step")
            dag = [{"step_id": i, "analysis": "", "depends_on": [i - 1], "macro_action_tag": ["Define", "Derive"][i % 2]} for i in range(1, n + 1)]
            f.write(json.dumps({"custom_id": r["custom_id"], "response": {"body": {"choices": [{"message": {"content": json.dumps(dag)}}]}}}) + "\n")
    run("merge", "--input", tmp_path / "seg", "--results", results, "--output", tmp_path / "merged")
    assert all(s["dag_analysis"] and s["dag_error"] is None for r in lines(tmp_path / "merged") for s in r["simple"]["samples"])
    run("ged", "--results", results, "--records", path, "--output", tmp_path / "ged", "--csv", tmp_path / "csv")
    rows = lines(tmp_path / "ged")
    assert len(rows) == 8 and sorted({r["ged"] for r in rows}) == [0.0, 2.0, 4.0, 6.0]
    run("select", "--input", tmp_path / "ged", "--output", tmp_path / "train", "--top-k", 2)
    chosen = lines(tmp_path / "train")
    assert sorted(r["ged_score"] for r in chosen) == [2.0, 2.0, 4.0, 4.0] and {r["target_alpha"] for r in chosen} == {0.0}
    run("split", "--input", tmp_path / "train", "--output", tmp_path / "part", "--ratios", 0.5, 0.5, 0.0)
    assert len(lines(tmp_path / "part_train")) == len(lines(tmp_path / "part_val")) == 2
    run("accuracy", "--input", path, "--compare", path)
    run("errors", "--input", path, "--output", tmp_path / "err", "--filter", "original_not_simple")
    assert lines(tmp_path / "err") == []
    run("sort", "--input", path, "--output", tmp_path / "sorted")
    assert [r["problem_id"] for r in lines(tmp_path / "sorted")] == [2, 11]
    run("report", "--input", path, "--output", tmp_path / "page.html")
    assert (tmp_path / "page.html").exists()
