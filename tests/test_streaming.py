from conftest import rows

from stemma import model as M
from stemma.sources import nquads
from stemma.streaming import imports, quota


def line(moment, ip):
    return (f"{moment} --- {ip} --- POST",)


def log(spark, lines):
    return quota.parse_log(spark.createDataFrame(lines, "value string"))


def test_parse_log(spark):
    got = log(spark, [line("2024-01-01 00:09:58.778549", "10.0.0.1"), ("broken",)]).collect()
    assert [(str(r.ts), r.ip, r.request) for r in got] == [
        ("2024-01-01 00:09:58.778549", "10.0.0.1", "POST")]


def test_quota(spark):
    lines = [line(f"2024-01-01 10:00:{i % 60:02d}", "1.2.3.4") for i in range(150)]
    lines += [line(f"2024-01-01 11:00:{i % 60:02d}", "11.2.3.45") for i in range(151)]
    lines += [line("2024-01-01 23:59:59", "5.5.5.5"), line("2024-01-02 00:00:00", "5.5.5.5")]
    got = [(c, str(d), n, b) for c, d, n, b in rows(quota.daily_quota(log(spark, lines)))]
    assert got == [("1.2.3.4", "2024-01-01", 150, False), ("11.2.3.45", "2024-01-01", 151, True),
                   ("5.5.5.5", "2024-01-01", 1, False), ("5.5.5.5", "2024-01-02", 1, False)]


def run(spark, inbox, tmp_path):
    stream = quota.parse_log(spark.readStream.text(str(inbox)))
    quota.run_quota(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 2).awaitTermination()
    updates = spark.read.option("basePath", str(tmp_path / "out")).parquet(
        str(tmp_path / "out/batch=*"))
    return [(c, str(d), n, b) for c, d, n, b in rows(quota.latest_counts(updates))]


def test_quota_stream_continues_and_drops_late_events(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def put(name, *lines):
        (inbox / name).write_text("".join(x[0] + "\n" for x in lines))

    put("1.txt", line("2024-01-01 10:00:00", "a"), line("2024-01-01 10:00:01", "a"))
    assert run(spark, inbox, tmp_path) == [("a", "2024-01-01", 2, False)]
    put("2.txt", line("2024-01-01 23:00:00", "a"), line("2024-01-05 00:00:00", "a"))
    assert run(spark, inbox, tmp_path) == [
        ("a", "2024-01-01", 3, True), ("a", "2024-01-05", 1, False)]
    # The watermark has passed the first day, so this one is late.
    put("3.txt", line("2024-01-01 12:00:00", "a"), line("2024-01-05 00:00:01", "b"))
    assert run(spark, inbox, tmp_path) == [
        ("a", "2024-01-01", 3, True), ("a", "2024-01-05", 1, False), ("b", "2024-01-05", 1, False)]


def test_import_stream_ignores_what_was_sent_before(spark, quads, tmp_path):
    inbox = tmp_path / "inbox"
    lines = nquads.nquads_lines(quads)

    def go():
        imports.run_import(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp")
                           ).awaitTermination()
        return rows(imports.imported(spark, str(tmp_path / "out")))

    lines.write.mode("append").text(str(inbox))
    assert go() == rows(quads.distinct())
    lines.write.mode("append").text(str(inbox))
    assert go() == rows(quads.distinct())
    more = spark.createDataFrame([("<urn:s> <urn:p> <urn:o> <urn:g/> .",)], "value string")
    more.write.mode("append").text(str(inbox))
    assert len(go()) == quads.distinct().count() + 1
    assert M.QUAD_COLUMNS == ["s", "p", "o", "o_kind", "o_type", "g"]


def test_verdict_on_each_request(spark):
    import random
    rng = random.Random(1)
    told = [(i, f"2024-01-0{rng.choice([1, 1, 1, 2])} {rng.randint(10, 23)}:00:00", rng.choice("aaaaaab"),
             rng.choice(["POST /x", "GET /y"])) for i in range(300)]
    told += [(300, None, "a", "POST"), (301, None, "a", "GET"), (302, "2024-01-01 10:00:00", None, "POST"),
             (303, "2024-01-01 10:00:00", "a", None)]
    rng.shuffle(told)
    log = spark.createDataFrame(told, "n int, t string, ip string, request string").selectExpr(
        "n", "cast(t as timestamp) as ts", "ip", "request")
    for parts in (1, 13):
        got = {r.n: (r.n_requests, r.blocked) for r in quota.request_verdicts(
            log, 20, order=("ts", "n"), parts=parts).collect()}
        seen, want = {}, {}
        for n, t, ip, request in sorted(told, key=lambda r: (r[1] or "", r[0])):
            key = (ip, t and t[:10])
            seen[key] = seen.get(key, 0) + ((request or "").startswith("POST"))
            want[n] = (seen[key], seen[key] > 20)
        assert got == want and any(b for _, b in want.values())
