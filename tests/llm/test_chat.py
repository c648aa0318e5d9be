import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from cpgdomains.llm.chat import Template, format_chats, read_back

SCHEMA = "conv_id long, turn long, role string, text string, n long, segment string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    groups = {}
    for r in sorted(rows, key=key):
        groups.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = []
    for c, turns in groups.items():
        lost = "".join(t for role, t in turns if role == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "### Assistant: hi </turn>\n"), (1, 2, "assistant", "\\### Assistant: </turn> ok\\"), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", None),
    (3, 1, None, "x: y"), (4, None, "user", ""), (4, 0, "assistant", "####: \\h\\e"), (5, 0, "we: ird\n###", "t"), (None, 0, "user", "q"), (6, 0, "user", "same"), (6, 0, "user", "same"), (6, 0, "assistant", "same"),
]


def test_read_back_against_brute_force(spark):
    found = read_back(format_chats(table(spark, ROWS))).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute(ROWS)
    valid = {r.conv_id: r.valid for r in found}
    assert valid[1] and valid[2] and valid[4] and not valid[3] and not valid[5] and not valid[6] and not valid[None]


def test_segments_and_flags(spark):
    rows = format_chats(table(spark, ROWS)).where("conv_id = 2").collect()
    assert [r.segment for r in rows] == ["### user: ", "a", " </turn>\n", "### assistant: ", "b", " </turn>\n"]
    assert [r.loss for r in rows] == [False, False, False, False, True, False]


def test_many_turns_and_empty_table(spark):
    rows = [(9, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(3000)]
    r = read_back(format_chats(table(spark, rows))).first()
    assert r.n_turns == 3000 and r.valid and (r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute(rows)[0]
    assert read_back(format_chats(table(spark, []))).count() == 0


@given(st.text(st.sampled_from(list("\\#he</turn> :c\nA")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_markers(text):
    t = Template()
    safe = t.escape(text)
    assert t.unescape(safe) == text and "###" not in safe and "</turn>" not in safe and ": " not in safe
