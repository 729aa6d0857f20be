"""Each catalogued query against its SQL, and the others against plain Python."""

import random

import pytest

from scrollweave import catalog
from scrollweave.operators import dedup

from .conftest import DATA, duck_rows, rows


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = df.collect()
    assert sorted(df.columns) == sorted(duck.sql(catalog.SQL[name]).columns)
    assert len(got) == len(duck_rows(duck, catalog.SQL[name]))
    assert rows(df) == duck_rows(duck, catalog.SQL[name])


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def plain_ratio(a: str, b: str) -> float:
    """By the whole table of common subsequences."""
    if not a or not b:
        return float(a == b)
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 2 * row[-1] / (len(a) + len(b))


def plain_overlap(first: str, second: str, least: int) -> tuple[int, int]:
    for k in range(min(len(first), len(second)), least - 1, -1):
        if plain_ratio(first[-k:], second[:k]) > 0.85:
            return len(first) - k, k
    return -1, 0


def plain_addition(known: str, text: str, threshold: float) -> str | None:
    if not known or not text:
        return text or None
    if plain_ratio(plain(known), plain(text)) > threshold:
        return None
    at, size = plain_overlap(plain(known), plain(text), 20)
    used = len(plain(text)[: max(size, 0)].split())
    if at >= 0 and used < len(text.split()):
        return " ".join(text.split()[used:])
    last = [plain(line) for line in known.split("\n")[-20:]]
    return "\n".join(line for line in text.split("\n") if line.strip() and all(plain_ratio(plain(line), o) <= threshold for o in last)) or None


def plain_scroll(texts: list[str], threshold: float = 0.85, least: int = 10, window: int = 3) -> list[str]:
    """Frame by frame: like the end of what was shown, like a recent frame, what it adds, its new lines."""
    shown, recent, out = "", [], []
    for text in (t.strip() for t in texts):
        if not text:
            continue
        tail = shown[-2 * len(text) :]
        new = None
        if not (shown and plain_ratio(plain(text), plain(tail)) > threshold) and all(plain_ratio(plain(text), plain(r)) <= threshold for r in recent):
            new = plain_addition(shown, text, threshold)
            if new is None or len(new.strip()) < least:
                old = {plain(line) for part in (shown, *recent) for line in part.split("\n") if line.strip()}
                new = "\n".join(line.strip() for line in text.split("\n") if line.strip() and all(plain_ratio(plain(line), o) <= threshold for o in old))
        if new is not None and len(new.strip()) >= least:
            out.append(new)
            shown += " " + new
        recent = [*recent, text][-window:]
    return out


def made_up_frames(seed: int) -> list[str]:
    """A window that scrolls over lines, with slips of the pen, repeats, blanks and jumps back."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["Alpha", "beta", "Gamma", "delta", "eps", "zeta one", "two"]) for _ in range(rng.randint(1, 3))) for _ in range(7)]
    at, out = 0, []
    for _ in range(9):
        at = max(0, min(len(pool) - 2, at + rng.choice((0, 1, 1, 2, -2))))
        text = "\n".join(pool[at : at + rng.randint(1, 3)])
        if rng.random() < 0.3 and text:
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice("xyz") + text[k + 1 :]
        out.append(rng.choice(("", "  ")) if rng.random() < 0.1 else text)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_scroll_state_against_plain(seed):
    texts = made_up_frames(seed)
    for threshold, least, window in ((0.85, 10, 3), (0.7, 4, 1)):
        state = dedup.ScrollState(threshold, least, window)
        got = []
        for k, text in enumerate(texts):
            if k == 4:  # as a stream's next micro-batch takes up its state
                state = dedup.ScrollState(threshold, least, window, state.shown, list(state.recent))
            if (new := state.take(text)) is not None:
                got.append(new)
        assert got == plain_scroll(texts, threshold, least, window)


@pytest.mark.parametrize("seed", range(40))
def test_overlap_and_new_content_against_plain(seed):
    from scrollweave.functions import similarity as S

    first, second = ("\n".join(filter(str.strip, made_up_frames(s)[:4])) for s in (seed, seed + 1))
    second = first[len(first) // 2 :] + " " + second if seed % 2 else second
    for least in (1, 5, 20):
        assert S.overlap(first, second, least) == plain_overlap(first, second, least)
    assert S.new_content(first, second) == plain_addition(first, second, 0.85)


def test_overlap_costs_a_few_comparisons_of_whole_texts(monkeypatch):
    from scrollweave.functions import similarity as S

    rng, spent = random.Random(4), []
    first, second = (" ".join(rng.choice(["the", "thing", "and", "of", "ing", "there", "an"]) + rng.choice("abcdef") for _ in range(400)) for _ in range(2))
    counted = S._matched
    monkeypatch.setattr(S, "_matched", lambda a, places, size, least=0: spent.append(size * size) or counted(a, places, size, least))
    assert S.overlap(first, second) == (-1, 0)
    assert sum(spent) < 5 * min(len(first), len(second)) ** 2


def test_overlap_skips_sizes_by_what_shorter_beginnings_have_in_common(monkeypatch):
    from scrollweave.functions import similarity as S

    rng, spent, counted = random.Random(4), [], S._matched
    monkeypatch.setattr(S, "_matched", lambda a, places, size, least=0: spent.append(size * size) or counted(a, places, size, least))
    for letters in ("thaneriosn ", "abc", "a\u4e16\U0001f600 e"):
        first, second = ("".join(rng.choice(letters) for _ in range(300)) for _ in range(2))
        for threshold in (0.85, 0.9, 1.0):
            spent.clear()
            assert S.overlap(first, second, 20, threshold) == (-1, 0)
            assert sum(spent) < 2.5 * 300**2


@pytest.mark.parametrize("name", ["find_new_content", "find_overlap"])
def test_compared_frames_go_through_many_tasks(spark, name):
    df = catalog.queries()[name](spark, DATA)
    assert df.rdd.getNumPartitions() >= 32
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_ratio_over_threshold_against_plain():
    from scrollweave.functions import similarity as S

    rng = random.Random(5)
    for k in range(60):
        a = "".join(rng.choice("abcde \u4e16\U0001f600") for _ in range(rng.randint(90, 300)))
        b = "".join(ch for ch in a if rng.random() > 0.01 * k)
        b = b + a[: k % 7]
        for threshold in (0.5, 0.85, 0.95, plain_ratio(a, b)):
            assert S.over(a, b, threshold) == (plain_ratio(a, b) > threshold)


def test_boxes_are_sorted_once_for_lines(spark):
    from pyspark.sql import functions as F

    from scrollweave.operators import layout

    box = "array<struct<y:int,x:int,idx:int,w:int,h:int,text:string>>"
    df = spark.createDataFrame([([(0, 0, 0, 1, 1, "a"), (5, 0, 1, 1, 1, "b"), (21, 0, 2, 1, 1, "c"), (50, 0, 3, 1, 1, "d")],), ([],)], f"b {box}")
    lined = df.select(layout._lines(F.col("b"), lambda y, first: F.abs(y - first) > 20).alias("l"))
    assert [[[b.text for b in line] for line in r.l] for r in lined.collect()] == [[["a", "b"], ["c"], ["d"]], []]
    plan = lined._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and plan.count("aggregate(") == 1


def test_native_ratio_of_short_and_long_texts(spark):
    from pyspark.sql import functions as F

    from scrollweave.functions import similarity as S

    rng = random.Random(6)
    texts = [tuple("".join(rng.choice("abc é\U0001f600") for _ in range(n)) for n in sizes) for sizes in ((0, 0), (0, 3), (5, 0), (1, 1), (70, 62), (62, 62), (30, 61), (40, 63), (9, 64), (80, 12))]
    df = spark.createDataFrame([*texts, (None, "a"), ("a", None)], "a string, b string").select("a", "b", S.ratio_native(F.col("a"), F.col("b")).alias("r"))
    for r in df.collect():
        assert r.r is None if None in (r.a, r.b) else abs(r.r - plain_ratio(r.a, r.b)) < 1e-12
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftleft" in plan.lower() or "<<" in plan


@pytest.mark.parametrize("name", ["image_similarity", "image_similarity_mse"])
def test_histograms_are_not_broadcast(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_simple_dedup_against_plain(spark):
    want, found = [], []
    for v in range(6):
        shown = None
        for pos, text in enumerate(made_up_frames(100 + v)):
            found.append((f"v{v}", pos, text))
            new = text if shown is None else plain_addition(shown, text, 0.85)
            if shown is None or (new and len(new.strip()) >= 10):
                shown = text if shown is None else f"{shown} {new}"
                want.append((f"v{v}", new))
    got = dedup.simple_dedup(spark.createDataFrame(found, "video_id string, pos int, text string")).orderBy("video_id", "seq").collect()
    assert [(r.video_id, r.text) for r in got] == want


def test_recordings_go_through_many_tasks_as_a_stream(spark):
    """However few bytes they are, and whatever batches cut them: frames out of order, null texts and a null recording, too."""
    found, want = [], {}
    for v in range(12):
        texts = [t or None for t in made_up_frames(300 + v)]
        name = None if v == 11 else f"v{v}"
        found += [(name, k, k * 0.5, t, None if k % 2 else 0.9) for k, t in enumerate(texts)]
        want[name] = plain_scroll([t or "" for t in texts])
    random.Random(1).shuffle(found)
    frames = spark.createDataFrame(found, "video_id string, frame_number int, timestamp_seconds double, full_text string, average_confidence double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        blocks = dedup.scroll_dedup(frames)
        got = blocks.collect()
        simple = dedup.simple_dedup(frames.selectExpr("video_id", "frame_number AS pos", "full_text AS text"))
        assert simple.count() >= 12
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {v: [r.text for r in sorted((r for r in got if r.video_id == v), key=lambda r: r.seq)] for v in want} == want
    assert all(r.timestamp_seconds == r.source_frame * 0.5 and r.confidence == (None if r.source_frame % 2 else 0.9) and r.is_new for r in got)
    for df in (blocks, simple):
        assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString() and df.rdd.getNumPartitions() >= 32


def test_scroll_dedup_and_stream_agree_with_plain(spark):
    from scrollweave.plans import views

    want = {}
    for r in views.frames_text(spark, DATA).collect():
        want.setdefault(str(r.video_id), []).append((r.frame_number, r.full_text))
    short = {v: f for v, f in want.items() if sum(len(t) for _, t in f) < 700}
    batch = sorted((r.video_id, r.seq, r.text) for r in catalog.queries()["scroll_dedup"](spark, DATA).collect())
    live = sorted((r.video_id, r.seq, r.text) for r in catalog.queries()["scroll_dedup_streaming"](spark, DATA).collect())
    assert batch == live and len(batch) > len(want)
    assert short and [x for x in batch if x[0] in short] == sorted((v, k, t) for v, f in short.items() for k, t in enumerate(plain_scroll([t for _, t in sorted(f)])))


def test_fuzzy_anti_against_plain(spark):
    rng = random.Random(3)
    lines = [line for seed in range(30) for text in made_up_frames(seed)[:3] for line in text.split("\n")]
    current, known = [(i % 5, i, line) for i, line in enumerate(lines)], [(rng.randrange(5), line[:-1] + "q") for line in lines[::3]]
    want = {i for v, i, line in current if not any(v == w and plain_ratio(plain(line), plain(o)) > 0.85 for w, o in known)}
    got = dedup.fuzzy_anti(spark.createDataFrame(current, "video_id int, id int, line string"), spark.createDataFrame(known, "video_id int, line string"))
    assert {r.id for r in got.collect()} == want and 0 < len(want) < len(current)
    every = catalog.queries()["fuzzy_anti_lines"](spark, DATA).count()
    assert 0 < every < sum(t.count("\n") + 1 for t in [r.full_text for r in views_frames(spark)])


def views_frames(spark):
    from scrollweave.plans import views

    return views.frames_text(spark, DATA).collect()


def test_pairs_over_threshold_many_at_once(monkeypatch):
    import numpy as np

    rng = random.Random(2)
    left = ["".join(rng.choice("abcde \u00e9\U0001f600") for _ in range(rng.choice((1, 5, 40, 63, 64, 65, 128, 130)))) for _ in range(9)]
    right = ["".join(c if rng.random() > 0.1 else "z" for c in rng.choice(left)) for _ in range(12)]
    i, j = np.divmod(np.arange(108), 12)
    for threshold, at_once in ((0.3, 7), (0.7, 4096), (0.85, 7)):
        monkeypatch.setattr(dedup, "AT_ONCE", at_once)
        want = [plain_ratio(left[x], right[y]) > threshold for x, y in zip(i, j, strict=True)]
        assert dedup._pairs_over(left, right, i, j, threshold).tolist() == want and any(want) and not all(want)


def test_blocks_of_lines_meet_in_one_direction_in_many_tasks(spark):
    lines = spark.createDataFrame([(k, f"line number {k} of many") for k in range(300)], "l int, lt string")
    pairs = dedup.similar_pairs(lines, lines)
    assert "RepartitionByExpression" in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(sorted((r.l, r.r))) for r in pairs.collect()} == {(x, y) for x in range(300) for y in range(x, 300) if plain_ratio(f"line number {x} of many", f"line number {y} of many") > 0.85}


def test_cross_dedup_is_greedy_keep_first(spark):
    texts = ["The quick brown fox\nabc\nHello there world\nThe quick brown fix", "the quick  brown fox\nHello there worlds!\nsomething else entirely\nThe quack brown fix", "something else entirely.\nnew line of text here", *("\n".join(made_up_frames(s)) for s in range(5))]
    kept, want = [], []
    for i, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            n = plain(line)
            if len(n) >= 5 and not any(plain_ratio(n, o) > 0.85 for o in kept):
                kept.append(n)
                want.append((i, k, line.strip()))
    df = spark.createDataFrame(list(enumerate(texts)), "pos int, text string")
    assert sorted((r.pos, r.line_no, r.line) for r in dedup.cross_dedup(df).collect()) == want
    assert dedup.cross_dedup_text(df).first().content == "\n".join(x[2] for x in want)
    one = spark.createDataFrame([(0, "a\n\na")], "pos int, text string")
    assert dedup.cross_dedup_text(one).first().content == "a\n\na"
    assert dedup.cross_dedup_text(df.limit(0)).first().content == ""


@pytest.mark.parametrize("merge", [True, False])
def test_entry_parser_line_by_line(spark, merge):
    from scrollweave.operators import transcript
    from scrollweave.streaming.entries import EntryParser

    rng = random.Random(7)
    pool = ["John Smith", "Jane Doe", "11:30:00", "11:30:45", "12:00:00 after", "Ann Lee 11:31:10 both", "no name 11:32:00", "OK", "JD", "", "  ", "[x] Bob:", "some words of text.", "Another line here?", "@handle", "x" * 70, "Yes.", "A long sentence that Is not a name at all", "\u2003Zoë\u00a0 ", "9:05:07"]
    texts = [[rng.choice(pool) for _ in range(rng.randint(0, 25))] for _ in range(150)]
    want = {}
    df = spark.createDataFrame([(i, k, line) for i, t in enumerate(texts) for k, line in enumerate(t)], "video_id int, line_no int, line string")
    for r in transcript.parse(df, merge=merge).orderBy("video_id", "entry_no").collect():
        want.setdefault(r.video_id, []).append((r.speaker, r.timestamp, r.timestamp_seconds, r.text))
    for i, t in enumerate(texts):
        parser, got = EntryParser(merge), []
        for line in t:
            got += parser.take(line)
            parser = EntryParser(merge, kept=parser.kept)
        assert got + parser.end() == want.get(i, [])


def test_combined_json_is_one_list_of_finished_pieces(spark):
    """The last task joins texts: it gets each recording as one entry, already as JSON, with odd letters and empty texts."""
    import json
    import re

    from pyspark.sql import functions as F

    from scrollweave.operators import formats

    odd = 'a "b" \\ \t\u2028 \U0001f600 \x01\nnext  line'
    texts = spark.createDataFrame([(2, "v\"2", odd), (1, "v1", ""), (3, "v3", None), (4, "v4", "plain words"), (None, "v0", "of no place")], "pos int, video_id string, raw_text string")
    entries = spark.createDataFrame([("v\"2", 1, "Ann \"A\"", "10:00:00", 36000, odd, 0.91234), ("v\"2", 0, "", "09:00:00", 32400, "x", None)], "video_id string, entry_no int, speaker string, timestamp string, timestamp_seconds int, text string, confidence double")
    df = formats.combined(texts, entries, kind="json")
    said = json.loads(df.first().content)
    assert list(said) == ["metadata", "videos", "combined_raw_text", "statistics"]
    assert said["metadata"] == {"combined_from": ["v0", "v1", "v\"2", "v3", "v4"], "total_videos": 5, "deduplicated": False}
    assert [v["filename"] for v in said["videos"]] == said["metadata"]["combined_from"]
    assert said["videos"][2]["transcript"] == [{"speaker": "", "timestamp": "09:00:00", "timestamp_seconds": 32400, "text": "x"}, {"speaker": "Ann \"A\"", "timestamp": "10:00:00", "timestamp_seconds": 36000, "text": odd, "confidence": 0.912}]
    assert said["combined_raw_text"] == f"of no place\n\n{odd}\n\nplain words"
    assert said["statistics"] == {"total_words": len(said["combined_raw_text"].split())}
    last = re.search(r"(?:Object|Sort|Hash)\w*Aggregate\(.*partial_collect_list.*partial_count\(1\).*|(?:Object|Sort|Hash)\w*Aggregate\(.*partial_count\(1\).*partial_collect_list.*", df._jdf.queryExecution().executedPlan().toString())
    assert last and last[0].count("partial_collect_list(") == 1
    for joined, want in (("a\nb \"c\"", {"combined_raw_text": "a\nb \"c\"", "statistics": {"total_words": 3}}), (None, {"statistics": {}})):
        content = formats.combined(texts, entries, spark.range(1).select(F.lit(joined).cast("string").alias("content")), kind="json").first().content
        assert {k: v for k, v in json.loads(content).items() if k not in ("metadata", "videos")} == want
    assert formats.combined(texts.limit(0), entries, kind="json").first().content == ""


def test_json_has_what_sql_says(spark, duck):
    import json

    got = {r.video_id: json.loads(r.content) for r in catalog.queries()["format_json"](spark, DATA).collect()}
    stats = {r.video_id: r for r in catalog.queries()["transcript_stats"](spark, DATA).collect()}
    for key, said in got.items():
        assert list(said) == ["metadata", "transcript", "raw_text", "statistics"]
        if key in stats:
            assert said["statistics"]["total_messages"] == len(said["transcript"]) == stats[key].messages
            assert said["statistics"]["word_count"] == stats[key].word_count
