"""Values worked out by hand."""

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from scrollweave import log
from scrollweave.functions import similarity as S
from scrollweave.functions import text as T
from scrollweave.operators import dedup, detections, formats, frames, images, jobs, layout, recognize, transcript
from scrollweave.plans import pipeline
from scrollweave.sources import config, sinks, video

SAMPLE = """John Smith
11:30:00
Hello everyone, welcome to the meeting.

Jane Doe
11:30:15
Thanks for joining us today.

John Smith
11:30:30
Let's begin with the agenda.
We have three topics to discuss today.

Jane Doe
11:31:00
First topic is the project update."""


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("a", "b", "want"), [("hello world", "hello there", 0.6363636), ("Hello", "hello", 1.0), ("", "", 1.0), ("hello", "", 0.0), ("abc", "xyz", 0.0)])
def test_ratio(spark, a, b, want):
    assert S.ratio(a, b) == pytest.approx(want)
    assert value(spark, S.indel_ratio(F.lit(a), F.lit(b))) == pytest.approx(want)
    if a == a.lower():
        assert value(spark, S.ratio_native(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_raw_ratio_and_threshold():
    assert S.ratio("Hello", "hello", False) == pytest.approx(0.8)
    assert not S.over("a" * 17 + "bcd", "a" * 17 + "xyz", 0.85)


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", max_size=24), st.text("abcé", max_size=24))
def test_end_to_start(a, b):
    assert S.end_to_start(a, b).tolist() == [0, *(S.lcs(a[-k:], b[:k]) for k in range(1, min(len(a), len(b)) + 1))]


def test_overlap():
    assert S.overlap("The quick brown fox jumps over", "fox jumps over the lazy dog", 10) == (14, 16)
    assert S.overlap("hello world test", "test again", 3) == (12, 4)
    assert S.overlap("hello world test", "test again", 10) == (-1, 0)


def test_new_content():
    assert S.new_content("Line 1 content\nLine 2 content\nLine 3 content", "Line 2 content\nLine 3 content\nLine 4 content") is None
    assert S.new_content("", "x") == "x"
    assert S.new_content("x", "") is None


def scroll(texts, **kw):
    state = dedup.ScrollState(**kw)
    return [new for t in texts if (new := state.take(t)) is not None]


def test_scroll():
    assert scroll(["Hello world, this is a test message"] * 5) == ["Hello world, this is a test message"]
    assert scroll(["Line 1: First message\nLine 2: Second message", "Line 2: Second message\nLine 3: Third message", "Line 3: Third message\nLine 4: Fourth message"]) == ["Line 1: First message\nLine 2: Second message", "3: Third message", "Line 4: Fourth message"]
    assert scroll(["", "Some text here", "   ", "Completely different content now"]) == ["Some text here", "Completely different content now"]


def parse(spark, text, merge=True):
    lines = transcript.explode_lines(spark.createDataFrame([("v", text)], "video_id string, text string"))
    return transcript.parse(lines, merge=merge)


def entries(df):
    return [(r.speaker, r.timestamp_seconds, r.text) for r in df.orderBy("entry_no").collect()]


def test_parse(spark):
    want = [("John Smith", 41400, "Hello everyone, welcome to the meeting."), ("Jane Doe", 41415, "Thanks for joining us today."), ("John Smith", 41430, "Let's begin with the agenda. We have three topics to discuss today."), ("Jane Doe", 41460, "First topic is the project update.")]
    got = parse(spark, SAMPLE)
    assert entries(got) == want == entries(parse(spark, SAMPLE, False))
    assert [r.speaker for r in transcript.speakers(got).orderBy("position").collect()] == ["John Smith", "Jane Doe"]
    assert entries(parse(spark, "Speaker\n11:30:00\nMessage")) == []
    assert entries(parse(spark, "")) == []


def test_merge_anchor(spark):
    rows = [("v", i, s, "", t, x, 0.0) for i, (s, t, x) in enumerate([("A", 0, "a"), ("A", 50, "b"), ("A", 70, "c"), ("B", 71, "d"), ("A", 72, "e")], 1)]
    df = spark.createDataFrame(rows, "video_id string, entry_no int, speaker string, timestamp string, timestamp_seconds int, text string, confidence double")
    assert entries(transcript.merge_consecutive(df)) == [("A", 0, "a b"), ("A", 70, "c"), ("B", 71, "d"), ("A", 72, "e")]


def test_text(spark):
    assert value(spark, T.normalize(F.lit("  Hello   WORLD\n\tTest  "))) == "hello world test"
    assert value(spark, T.word_count(F.lit(" a  b "))) == 2 and value(spark, T.word_count(F.lit("  "))) == 0
    assert value(spark, T.clock(F.lit(3661.5))) == "01:01:01"
    assert value(spark, T.duration(F.lit(120.5))) == "2m 0s"
    assert value(spark, T.srt_clock(F.lit(41400.25))) == "11:30:00,250"
    assert value(spark, T.time_seconds(F.lit("99:99:99"))) == 362439 and value(spark, T.time_seconds(F.lit("2:03"))) == 123 and value(spark, T.time_seconds(F.lit("x"))) == 0
    assert value(spark, T.is_initials(F.lit(" OK "))) and not value(spark, T.is_initials(F.lit("Ok")))
    assert value(spark, T.clean_speaker(F.lit(" [x] John Smith: "))) == "John Smith"


def test_frames(spark):
    v = spark.createDataFrame([("a", "/x/a.mp4", True, 640, 480, 30.0, 60), ("b", "/x/b.xyz", True, 640, 480, 30.0, 60), ("c", "/x/c.mp4", False, 640, 480, 30.0, 60)], "video_id string, path string, present boolean, width int, height int, fps double, frame_count int")
    assert [(r.frame_number, r.timestamp_seconds) for r in frames.sample(v, 2).orderBy("frame_number").collect()] == [(0, 0.0), (15, 0.5), (30, 1.0), (45, 1.5)]
    assert [r.frame_number for r in frames.limit_frames(frames.sample(v, 10), 3).orderBy("frame_number").collect()] == [0, 3, 6]
    errors = {r.video_id: r.error for r in frames.validate(v).collect()}
    assert errors["a"] is None and "unsupported" in errors["b"].lower() and "not found" in errors["c"].lower()
    for native, target, want in ((29.97, 15, 2), (25.0, 2, 12), (30.0, 2, 15), (10.0, 20, 1)):
        assert value(spark, frames.interval(F.lit(native), target)) == want


def test_skip_similar(spark):
    import numpy as np

    def alike(a, b):
        va, vb = ((a - a.mean()) ** 2).sum(), ((b - b.mean()) ** 2).sum()
        r = ((a - a.mean()) * (b - b.mean())).sum() / (va * vb) ** 0.5 if va * vb else 1.0
        return (r + 1) / 2

    rng = np.random.default_rng(0)
    data = [rng.random(8) for _ in range(30)] + [np.ones(8)]
    df = spark.createDataFrame([("v", i, x.tolist()) for i, x in enumerate(data)], "video_id string, frame_number int, vector array<double>")
    last, want = None, []
    for i, x in enumerate(data):
        if last is None or not alike(last, x) > 0.6:
            want.append(i)
            last = x
    assert sorted(r.frame_number for r in frames.skip_similar(df, threshold=0.6).collect()) == want


def test_layout(spark):
    rows = [("v", 0, i, t, 0.9, x, y, 30, 10) for i, (y, x, t) in enumerate([(0, 50, "b"), (15, 10, "a"), (20, 90, "c"), (30, 5, "d"), (41, 1, "e")])]
    df = spark.createDataFrame(rows, "video_id string, frame_number int, idx int, text string, confidence double, x int, y int, w int, h int")
    assert layout.read_order(df).first().full_text == "a b c\ne d"


def test_recogniser(spark):
    class Fixed:
        def __init__(self, **_):
            pass

        def regions(self, image):
            return [("hi", 0.9, 1, 2, 3, 4), ("no", 0.1, 1, 2, 3, 4)]

    recognize.register(recognize.Engine("fixed", "Fixed", False, "", None, Fixed))
    df = spark.createDataFrame([("v", 0, 0.0, b"x"), ("v", 1, 0.5, b"y")], "video_id string, frame_number int, timestamp_seconds double, image binary")
    assert [(r.frame_number, r.text) for r in recognize.recognize(df, "FIXED").orderBy("frame_number").collect()] == [(0, "hi"), (1, "hi")]
    with pytest.raises(recognize.EngineError):
        recognize.get("nothing")
    assert not recognize.requires_gpu("nothing")


def test_formats_and_sinks(spark, tmp_path):
    got = parse(spark, SAMPLE)
    meta = spark.createDataFrame([("v", "m.mp4", 120.5, 10, 5, "2024-01-01T00:00:00Z", "table", 0.5)], "video_id string, source_file string, duration_seconds double, frames_processed int, frames_with_text int, extraction_timestamp string, ocr_engine string, confidence_threshold double")
    raw = spark.createDataFrame([("v", SAMPLE)], "video_id string, raw_text string")
    srt = formats.subtitles(got).first().content
    assert srt.startswith("1\n11:30:00,000 --> 11:30:15,000\n[John Smith] Hello everyone, welcome to the meeting.\n\n2\n")
    assert "- **Messages**: 4" in formats.markdown(got, meta, raw).first().content
    none = got.limit(0)
    assert formats.RAW_MARKDOWN in formats.markdown(none, meta, raw).first().content
    assert formats.NONE_TEXT in formats.plain_text(none, meta, raw.limit(0)).first().content
    assert sinks.save_files(formats.plain_text(got, meta, raw), str(tmp_path), "text") == 1
    assert (tmp_path / "v.txt").read_text().startswith("Source: m.mp4\nDuration: 2m 0s\n")
    assert sinks.target(None, "/a/b.mp4", "json") == "/a/b.json" and sinks.target(None, "/a/b.mp4", "all") == "/a/b"
    texts = raw.withColumn("pos", F.lit(1))
    for kind in ("json", "markdown", "text"):
        assert formats.combined(texts, got, kind=kind).first().content
    assert formats.combined(texts.limit(0), none, kind="text").first().content == ""
    assert formats.combined(texts, got, kind="srt").first().content is None


def test_settings(tmp_path):
    s = config.Settings({"ocr": {"engine": "doctr"}})
    assert s["ocr.engine"] == "doctr" and s["frame_extraction.fps"] == 2.0
    changed = s.overridden({"ocr": {"engine": None, "gpu": False}, "output": None})
    assert (changed["ocr.engine"], changed["ocr.gpu"], s["ocr.gpu"]) == ("doctr", False, True)
    for wrong in ({"output": {"formats": []}}, {"nothing": {}}):
        with pytest.raises(KeyError):
            config.Settings(wrong)
    file = tmp_path / "s.yaml"
    file.write_text("ocr:\n  languages: [en, de]\ndeduplication:\n")
    assert config.from_yaml(file)["ocr.languages"] == ("en", "de")
    assert dict(config.find(None, (tmp_path / "none.yaml", file))) == dict(config.from_yaml(file))
    assert dict(config.find(tmp_path / "none.yaml")) == dict(config.Settings()) and config.Settings(s.nested())["ocr.engine"] == "doctr"


def test_strip_of_a_long_run(spark):
    text = "a" + " " * 200_000 + "b" + "\u2003\n"
    began = time.perf_counter()
    assert value(spark, T.strip(F.lit(text))) == text.strip() and value(spark, T.word_count(F.lit(text))) == 2
    assert time.perf_counter() - began < 20
    assert [value(spark, T.strip(F.lit(x))) for x in ("", " ", "\n a \n", "a\n")] == ["", "", "a", "a"]


def test_sources(spark, tmp_path):
    for name in ("a.mp4", "b.MOV", "c.txt"):
        (tmp_path / name).write_bytes(b"x" * 10)
    found = video.files(spark, str(tmp_path))
    assert sorted((r.video_id, r.length) for r in found.collect()) == [("a.mp4", 10), ("b.MOV", 10)]
    got = {r.video_id: r for r in video.probed(found, lambda path: (640, 480, 25.0, 50) if path.endswith("mp4") else None).collect()}
    assert got["a.mp4"].fps == 25.0 and got["b.MOV"].width is None
    live = video.stream(spark, str(tmp_path)).writeStream.format("memory").queryName("landed").trigger(availableNow=True).start()
    live.awaitTermination()
    assert {r.video_id for r in spark.table("landed").collect()} >= {"a.mp4", "b.MOV"}


def test_scan(spark):
    v = spark.createDataFrame([("a", "/x/a.mp4", True, 640, 480, 4.0, 12)], "video_id string, path string, present boolean, width int, height int, fps double, frame_count int")
    rows = [("a", i, [float(x) for x in ((1, 2, 3, 5) if i < 6 else (5, 3, 2, 1))]) for i in range(12)]
    df = spark.createDataFrame(rows, "video_id string, frame_number int, vector array<double>")
    numbers = lambda **kw: sorted(r.frame_number for r in frames.scan(df, v, **kw).collect())
    assert numbers(target="2") == [0, 6] and numbers(target=None, similar=None) == [0, 2, 4, 6, 8, 10] and numbers(similar=None, most=2) == [0, 2]
    assert issubclass(frames.FrameError, frames.Failure) and issubclass(recognize.EngineError, frames.Failure) and issubclass(frames.DedupError, frames.Failure)


def test_repeated_frames_and_batches(spark):
    class Several:
        def __init__(self, **_):
            pass

        def regions_of(self, images):
            return [[(f"{len(images)}:{x.decode()}", 0.9, 1, 2, 3, 4)] for x in images]

    recognize.register(recognize.Engine("several", "Several", False, "", None, Several))
    df = spark.createDataFrame([("v", i % 5, float(i), str(i).encode()) for i in range(7)], "video_id string, frame_number int, timestamp_seconds double, image binary")
    seen = Observation()
    got = recognize.recognize(df.coalesce(1), "several", at_once=2, repeats="last", progress=seen).collect()
    assert sorted((r.frame_number, r.text.split(":")[1]) for r in got) == [(0, "5"), (1, "6"), (2, "2"), (3, "3"), (4, "4")]
    assert seen.get["texts_found"] == 5 and {r.text.split(":")[0] for r in got} <= {"1", "2"}
    with pytest.raises(Exception, match="repeats"):
        recognize.recognize(df, "several").collect()


def test_pixels(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    pictures = [rng.integers(0, 256, (h, w, 3), np.uint8) for h, w in ((4, 5), (1, 1), (3, 7))]
    rows = [("v", i, p.shape[1], p.shape[0], bytearray(p.tobytes()), 1, 1, 3, 9) for i, p in enumerate(pictures)] + [("v", 3, 2, 2, bytearray(b"short"), 0, 0, 1, 1), ("v", 4, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "video_id string, frame_number int, width int, height int, image binary, x int, y int, w int, h int")
    grey = [np.floor(p[..., 0] * 1868 / 16384 + p[..., 1] * 9617 / 16384 + p[..., 2] * 4899 / 16384 + 0.5).astype(int) for p in (x.astype(float) for x in pictures)]
    got = {r.frame_number: r for r in images.histogram(images.levels(df)).collect()}
    for i, g in enumerate(grey):
        assert got[i].levels == g.reshape(-1).tolist() and got[i].vector == np.bincount(g.reshape(-1), minlength=256).tolist()
    assert got[3].vector is None and got[4].levels is None
    cut = {r.frame_number: r for r in images.crop(df).collect()}
    for i, p in enumerate(pictures):
        want = p[1:10, 1:4]
        assert bytes(cut[i].image) == want.tobytes() and (cut[i].height, cut[i].width) == want.shape[:2]
    assert images.crop(df, None) is df
    flipped = {r.frame_number: r for r in images.reverse_channels(df).collect()}
    assert bytes(flipped[0].image) == pictures[0][..., ::-1].tobytes()
    saved = {r.frame_number: r.saved for r in images.save(df, f"{tmp_path}/frames").collect()}
    assert saved == {0: True, 1: True, 2: True, 3: True, 4: False} and spark.read.parquet(f"{tmp_path}/frames").count() == 5


def test_detections_on_odd_rows(spark):
    form = "video_id int, frame_number int, idx int, text string, chars array<string>, confidence double, bbox array<double>, polygon array<struct<x:double,y:double>>"
    rows = [(1, 0, 0, None, ["a", "b"], None, None, None), (1, 0, 1, "", None, 0.5, [1.9, 2.0, 1.95, 9.5], None), (1, 0, 2, " x ", None, 0.5, [1.0], None), (1, 0, 3, "  ", ["q"], 0.5, None, None)]
    got = [tuple(r)[2:] for r in detections.from_lines(spark.createDataFrame(rows, form)).collect()]
    assert got == [(0, "ab", 0.9, 0, 0, 100, 20), (2, "x", 0.5, 0, 0, 100, 20)]
    words = spark.createDataFrame([(1, 0, 0, "a", "95", 1, 2, 3, 4), (1, 0, 1, "b", "-1", 1, 2, 3, 4), (1, 0, 2, " \n", "95", 1, 2, 3, 4)], "video_id int, frame_number int, idx int, text string, conf string, left int, top int, width int, height int")
    assert [tuple(r)[2:] for r in detections.from_words(words).collect()] == [(0, "a", 0.95, 1, 2, 3, 4)]
    assert set(detections.FORMS) == set(recognize.ENGINES) - {"fixed", "several"} and detections.languages_option(("en", "de")) == "en+de"


def test_queue(spark):
    q = spark.createDataFrame([(i, i, (i * 7919) % 101 // 3) for i in range(300)], "item_id long, job_id long, added long")
    j = spark.createDataFrame([(i, ["processing", "complete"][i % 2]) for i in range(0, 300, 3)], "job_id long, status string")
    want = {k: n for n, (_, k) in enumerate(sorted(((i * 7919) % 101 // 3, i) for i in range(300)), 1)}
    assert {r.item_id: r.position for r in jobs.positions(q).collect()} == want
    more = jobs.positions(jobs.add(q, spark.createDataFrame([(1001, 1), (1000, 2)], "item_id long, job_id long")))
    assert {r.item_id: r.position for r in more.collect()} == want | {1000: 301, 1001: 302}
    busy = {i for i in range(0, 300, 6)}
    assert {r.item_id for r in jobs.remove(q, j).collect()} == busy
    assert {r.item_id for r in jobs.remove(q, j, q.filter("item_id in (0, 1, 3)")).collect()} == set(range(300)) - {1, 3}
    assert jobs.positions(q.limit(0)).collect() == []


def test_job_statistics(spark):
    stats = spark.createDataFrame([("a", 2, 3, 0), ("b", 1, 1, 5)], "video_id string, speakers long, messages long, word_count long")
    raw = spark.createDataFrame([("a", "x y z"), ("b", "p"), ("c", None)], "video_id string, raw_text string")
    shown = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "video_id string, has_text boolean")
    blocks = spark.createDataFrame([("a", 1)], "video_id string, n long")
    got = {r.video_id: tuple(r)[1:] for r in transcript.job_statistics(stats, raw, layout.text_frames(shown), blocks).collect()}
    assert got == {"a": (2, 3, 3, 3, 2, 1, 0.5), "b": (1, 1, 5, 1, 1, 1, 0.0), "c": (0, 0, 0, 0, 0, 0, 0.0)}


def test_combined(spark):
    got, texts = parse(spark, SAMPLE), spark.createDataFrame([("v", SAMPLE, 0), ("w", "only  words\n", 1), ("x", "", 2)], "video_id string, raw_text string, pos int")
    joined = spark.createDataFrame([(" all of it \n",)], "content string")
    text = lambda **kw: formats.combined(texts, got, **kw).first().content
    said = text(kind="text")
    assert "Videos: 3\nDeduplication: Disabled\n" in said and f"FILE: w\n{'-' * 60}\n\n{formats.RAW_TEXTS}\n\nonly  words\n" in said and said.endswith(f"FILE: x\n{'-' * 60}\n\n{formats.NONE_TEXTS}\n")
    assert "1. v\n2. w\n3. x\n\n---\n" in text(kind="markdown") and text(kind="markdown").endswith(f"\n---\n\n{formats.FOOTER}")
    only = text(kind="markdown", joined=joined)
    assert "## Combined Transcript (Deduplicated)\n\nall of it\n\n" in only and "**John Smith**" not in only
    whole = json.loads(text(kind="json"))
    assert whole["metadata"] == {"combined_from": ["v", "w", "x"], "total_videos": 3, "deduplicated": False}
    assert whole["videos"][0]["speakers"] == ["John Smith", "Jane Doe"] and whole["videos"][1]["transcript"] == [] and len(whole["videos"][0]["transcript"]) == 4
    assert whole["combined_raw_text"] == f"{SAMPLE}\n\nonly  words\n" and whole["statistics"]["total_words"] == len(whole["combined_raw_text"].split())
    assert json.loads(text(kind="json", joined=joined))["combined_raw_text"] == " all of it \n"


def test_saving_and_logging(spark, tmp_path):
    got = parse(spark, SAMPLE)
    meta = spark.createDataFrame([("v", "m.mp4", 120.5, 10, 5, "2024-01-01T00:00:00Z", "table", 0.5)], "video_id string, source_file string, duration_seconds double, frames_processed int, frames_with_text int, extraction_timestamp string, ocr_engine string, confidence_threshold double")
    raw = spark.createDataFrame([("v", SAMPLE)], "video_id string, raw_text string")
    out = sinks.save_all(got, meta, raw, f"{tmp_path}/all")
    assert set(out) == {"json", "markdown", "text", "srt"} and spark.read.option("lineSep", "\0").text(out["text"]).first().value.startswith("Source: m.mp4")
    assert sinks.auto_save(got, meta, raw, f"{tmp_path}/auto") == {"json": 1, "markdown": 1, "text": 1}
    assert (tmp_path / "auto/v_transcript.md").read_text().startswith("# Meeting Transcript")
    (tmp_path / "file").write_text("")
    assert sinks.auto_save(got, meta, raw, f"{tmp_path}/file") == {}
    made = sinks.contents(got, meta, raw)
    assert sinks.download(made, "json", "v").first().name == "v_transcript.json" and sinks.download(made, "text", "w").collect() == []
    with pytest.raises(ValueError):
        sinks.download(made, "pdf")
    log.set_up("nonsense", tmp_path / "logs/x.log").info("said")
    assert "said" in (tmp_path / "logs/x.log").read_text()
    log.set_up()


def test_pipeline(spark):
    words = [("v", 0, i, w, 0.9, 10 + 60 * i, 10, 50, 10) for i, w in enumerate("John Smith".split())]
    words += [("v", 0, 2, "11:30:00", 0.9, 10, 50, 50, 10), ("v", 0, 3, "Hello everyone, welcome to the meeting.", 0.9, 10, 90, 50, 10)]
    df = spark.createDataFrame([(*w, 0.0) for w in words], "video_id string, frame_number int, idx int, text string, confidence double, x int, y int, w int, h int, timestamp_seconds double")
    out = pipeline.transcripts(df)
    assert entries(out["entries"]) == [("John Smith", 41400, "Hello everyone, welcome to the meeting.")]
    assert out["statistics"].first().messages == 1


def test_pipeline_of_recordings(spark):
    v = spark.createDataFrame([("a", "/x/a.mp4", True, 640, 480, 2.0, 4), ("b", "/x/b.xyz", True, 640, 480, 2.0, 4), ("c", "/x/c.mov", True, 640, 480, 2.0, 2)], "video_id string, path string, present boolean, width int, height int, fps double, frame_count int")
    said = [("a", n, 0, "John Smith", 0.9, 10) for n in range(4)] + [("a", n, 1, f"11:30:0{n}", 0.9, 50) for n in range(4)] + [("a", n, 2, f"Message number {n} of the meeting, {'abcd'[n] * 30}", 0.9, 90) for n in range(4)] + [("a", 0, 3, "unsure", 0.2, 130), ("b", 0, 0, "never read", 0.9, 10)]
    regions = spark.createDataFrame([(a, n, i, t, c, 10, y, 50, 10, 99.0) for a, n, i, t, c, y in said], "video_id string, frame_number int, idx int, text string, confidence double, x int, y int, w int, h int, timestamp_seconds double")
    out = pipeline.run(v, regions, config.Settings({"frame_extraction": {"fps": 2.0, "max_frames": 3}, "transcript_parsing": {"merge_consecutive": False}}))
    assert {r.video_id: r.error for r in out["errors"].collect()} == {"b": "Unsupported format: .xyz"}
    assert {r.frame_number: r.timestamp_seconds for r in out["texts"].collect()} == {0: 0.0, 1: 0.5, 2: 1.0}
    assert "unsure" not in out["dedup"].first().full_text and {r.video_id: r.status for r in out["results"].collect()} == {"a": "success", "b": "error", "c": "success"}
    assert recognize.system_info(spark).first().cores == 4
