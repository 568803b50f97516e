import hashlib
import random
from itertools import product

from captrellis.llm.chat_format import format_turns, parse, read_back, render


def test_every_text_reads_back():
    parts = ["\\", "#", "##", "###", "<", "</turn>", " </turn>\n", ": ", ":", "a", "\n", "### user: ", "é🙂", ""]
    for pair in product(parts, parts):
        for role in ("user", "a: b", "x:", "", "\\", "###"):
            text = "".join(pair)
            rendered, a, b = render(role, text)
            assert parse(rendered) == (role, text, a, b, len(rendered))
            assert "###" not in rendered[4:] and rendered.count("</turn>") - rendered.count("\\</turn>") == 1
    rng = random.Random(0)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        rendered, a, b = render("assistant", text)
        assert parse(rendered) == ("assistant", text, a, b, len(rendered))
        if parse("### assistant: " + text + " </turn>\n") == ("assistant", text, 15, 15 + len(text), len(text) + 23):
            assert rendered == "### assistant: " + text + " </turn>\n"  # nothing is escaped without need


def test_digests(spark):
    nasty = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, None, None), (-7, 0, "user", nasty), (-7, 1, "assistant", nasty)]
    rows += [(None, 0, "assistant", ""), (2, None, "assistant", "x"), (2, 5, "assistant", "y" * 100000), (2, 5, "assistant", "y" * 100000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in read_back(format_turns(df.repartition(3))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb\n\n\n") and got[1].loss_sha256 == sha("b")
    assert got[-7].loss_sha256 == sha(nasty) and got[-7].turns_sha256 == sha(f"user\n{nasty}\nassistant\n{nasty}\n")
    assert got[2].loss_chars == 200001 and got[2].n_turns == 3 and got[None].loss_chars == 0
    assert read_back(format_turns(df.limit(0))).count() == 0
