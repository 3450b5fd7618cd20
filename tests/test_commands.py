from valence.__main__ import main
from valence.sources.csvfiles import POST_SCHEMA, read_posts, write_posts
from valence.sources.store import read_store


def test_lines_of_other_programs_and_rejects(spark, tmp_path, capsys):
    lines = [f"{4 * (i % 2)},{i},d,f,u,text {i}" for i in range(10)] + ["four,99,d,f,u,lost", "4,98,d,f,u,too,many"]
    (tmp_path / "posts.csv").write_bytes("\r\n".join(lines).encode())
    p = {n: str(tmp_path / n) for n in ("posts.csv", "train", "live", "rejects")}
    main(["split", "--posts", p["posts.csv"], "--train", p["train"], "--live", p["live"],
          "--any-line-end", "--single-line", "--post-rejects", p["rejects"]])
    assert "2 lines rejected" in capsys.readouterr().out
    assert sorted(r.line for r in spark.read.parquet(p["rejects"]).collect()) == sorted(lines[10:])
    kept = read_posts(spark, [p["train"], p["live"]]).collect()
    assert sorted(r.text for r in kept) == sorted(f"text {i}" for i in range(10))


def test_from_posts_to_report(spark, tmp_path, capsys):
    word = {0: ["bad", "awful"], 4: ["love", "great"]}
    rows = [(4 * (i % 3 > 0), i, "d", "f", "u", word[4 * (i % 3 > 0)][i % 2]) for i in range(100)]
    p = {n: str(tmp_path / n) for n in ("posts", "train", "live", "model", "in", "store", "cp", "curves")}
    write_posts(spark.createDataFrame(rows, POST_SCHEMA), p["posts"])

    main(["split", "--posts", p["posts"], "--train", p["train"], "--live", p["live"]])
    assert read_posts(spark, p["train"]).count() == 80
    main(["train", "--posts", p["train"], "--model", p["model"]])
    assert "accuracy: %100.00, error: %0.00" in capsys.readouterr().out
    main(["publish", "--posts", p["live"], "--path", p["in"]])
    main(["score", "--path", p["in"], "--model", p["model"], "--store", p["store"],
          "--checkpoint", p["cp"], "--until-empty", "--option", "maxFilesPerTrigger=2"])
    assert read_store(spark, p["store"]).count() == 20
    main(["report", "--store", p["store"], "--curves", p["curves"]])
    out = capsys.readouterr().out
    assert "|20        |100.0   |%100.0" in out and "confusion matrix" in out
    assert spark.read.parquet(p["curves"]).count() == 20
