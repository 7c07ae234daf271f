import pytest

from tessera.llm import turns as U

SCHEMA = "meeting_id string, title string, started_at_ms bigint, ended_at_ms bigint, start_millis bigint, end_millis bigint, text string, speaker_label string, speaker string, block int"


def rows(*segments):
    return [("m", "t", 1_000_000_000_000, None, *s, "x", 1) for s in segments]


def turns(spark, data):
    got = U.speaker_turns(spark.createDataFrame(data, SCHEMA)).orderBy("meeting_id", "turn_no").collect()
    return [(r["turn_no"], r["speaker"], r["start_millis"], r["text"]) for r in got]


@pytest.mark.parametrize("label,want", [("Speaker One", "s1"), ("[S2]", "s2"), (" s3 ", "s3"), ("Spk 4:", "s4"), ("SPEAKER_05", "s5"), ("speaker-6", "s6"), ("spk7", "s7"), ("?", None), (None, None), ("", None), ("Ana", "ana")])
def test_labels(label, want):
    assert U.speaker_of(label) == want


@pytest.mark.parametrize("text,want", [
    ("(00:02:32) [S4] uhm, Suppose it holds", (152000, "s4", "Suppose it holds")),
    ("[0:03:24.500] <v s4> Readers of *keyboard clicks* x", (204500, "s4", "Readers of x")),
    ("00:03:42 >> s4: Nothing in on on it, you know", (222000, "s4", "Nothing in on it")),
    ("SPEAKER_02 - Compared with the erm, stitcher", (None, "s2", "Compared with the stitcher")),
    ("um... [MUSIC] ♪ ♪", (None, None, "")), (None, (None, None, "")), ("  ", (None, None, "")),
    ("We meet at 16:30.", (None, None, "We meet at 16:30.")),
])
def test_parsing(text, want):
    assert U.parse_segment(text) == want


def test_turns(spark):
    data = rows(
        (5000, 6000, "third", "S1"), (1000, 2000, "first", "Speaker One"), (3000, 4000, "um", "s2"), (4000, 4500, "second", "spk 1"), (5000, 6000, "third", "S1"),
        (None, None, "[0:00:07.000] s2: fourth", "?"), (1_000_000_008_000, 1_000_000_009_000, "fifth", None), (None, 6500, "between", "s1"), (None, None, None, "s9"), (9000, None, "last", "s1"),
    )
    assert turns(spark, data) == [(1, "s1", 1000, "first second third between"), (2, "s2", 7000, "fourth fifth"), (3, "s1", 9000, "last")]
    assert turns(spark, []) == []


def test_leading_segments_without_a_speaker_and_block_borders(spark):
    data = rows((0, 10, "a", None), (10, 20, "b", "s1"), (U.BLOCK_MILLIS + 5, None, "c", "s1"), (3 * U.BLOCK_MILLIS, None, "d", "s2"))
    assert turns(spark, data) == [(1, "s1", 0, "a b c"), (2, "s2", 3 * U.BLOCK_MILLIS, "d")]
    assert turns(spark, rows((0, 1, "a", None))) == [(1, None, 0, "a")]


def test_conflicting_edges_are_dropped():
    order = U.precedence_order(3, [(0, 1, 3), (1, 2, 3), (2, 0, 2)], [0, 1, 2])
    assert order == [0, 1, 2]
    assert U.precedence_order(3, [(0, 1, 3), (2, 0, 2), (1, 2, 1)], [0, 1, 2]) == [2, 0, 1]


def test_a_large_meeting_equals_a_plain_walk(spark):
    """Speakers carried over many blocks, with gaps of unnamed segments, against one loop over the sorted segments."""
    import random

    rng = random.Random(8)
    data, plain = [], []
    for i in range(4_000):
        who = rng.choice([None, None, "s1", "s2", "s3"]) if i > 5 else None
        at = i * 40_000 + rng.randint(0, 20_000)
        data += rows((at, at + 10, f"w{i}", who))
        plain.append((at, who))
    want, speaker = [], None
    for at, who in plain:
        if who is not None and speaker is not None and who != speaker or not want:
            want.append([who, at])
        if who is not None:
            speaker = who
            want[-1][0] = who
    got = turns(spark, data)
    assert [(t[0], t[1], t[2]) for t in got] == [(i + 1, w, a) for i, (w, a) in enumerate(want)] and len(want) > 1_000


def test_segments_without_any_time_come_last_in_many_blocks(spark):
    data = rows((1000, 2000, "timed", "s1"), *[(None, None, f"word {i}", "s2") for i in range(300)])
    got = turns(spark, data)
    assert [(t[0], t[1]) for t in got] == [(1, "s1"), (2, "s2")] and len(got[1][3].split()) == 600
    assert U.ordered_segments(spark.createDataFrame(data, SCHEMA)).select("block").distinct().count() > 100
