"""Credentials beside marks, glued to other text, and beside base spans."""

import pytest

from wavetally.llm import secrets

GHP, GOOGLE = "ghp_" + "aB3dE6gH9jK2" * 3, "AIza" + "Sy7dQ2mXw9K" * 3 + "b4"


@pytest.fixture(scope="module")
def model():
    return secrets.Model()


def formats(text, model):
    return [text[s:e] for s, e, k in secrets.spans(text.encode(), model) if k == "format"]


@pytest.mark.parametrize("around", ["it is {}.", "it is {}...", "GH_PAT={}", "https://x.org/a/b?key={}&c=1", "/etc/keys/{}/now", "{}==", "see{}", "é {}. ü", "wordword-{}", "{}_old", "a.b+{}/c"])
@pytest.mark.parametrize("secret", [GHP, GOOGLE])
def test_credentials_beside_marks_and_glued(model, around, secret):
    assert formats(f"x {secret} y", model) == [secret]
    got = formats(around.format(secret), model)
    # Where text is glued to an end by a character of the format, it may count as its part.
    assert len(got) == 1 and secret in got[0]
    assert around.endswith("_old") or got == [secret]


def test_credentials_beside_base_spans(model):
    access = "AKIA" + "A1B2" * 4
    text = f"{access}/{GHP} and {GHP}.{access}"
    assert [text[s:e] for s, e, k in secrets.spans(text.encode(), model)] == [access, GHP, GHP, access]
    assert formats(f"{GHP}.{GHP}={GHP}", model) == [GHP] * 3


def test_learned_from_a_corpus(spark):
    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice(["tion", "er", "ing", "an", "ble", "th", "ou", "es"]) for _ in range(n))
    key = lambda: "zq9_" + "".join(rng.choices("XYZW0123456789", k=20))
    rows = [(i, f"{word(2)} {word(6)}inging {word(7)}ering. token={key()} {word(3)}") for i in range(300)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    mine = secrets.learn(df)
    # A format that no pattern and no drawn example knows, without its keyword; long plain words stay.
    fresh = [key() for _ in range(50)]
    assert sum(formats(f"see {k} there", mine) == [k] for k in fresh) >= 45
    assert not any(formats(f"{word(6)}inging {word(7)}ering", mine) for _ in range(200))
    assert not any(formats(w, mine) for w in ("erbleenaneringti", "Areontiontiontion", "Andretioningtion", "Aneaththreedenble"))
    assert secrets.learn(df.limit(0)).margin == 0.0
    assert secrets.redact(df.limit(0), mine).count() == 0


def test_redacted_at_the_end_of_a_sentence(spark, model):
    df = spark.createDataFrame([(f"Use {GHP}. Or GH_PAT={GHP}",)], "text string")
    assert secrets.redact(df, model).first()["text"] == "Use [secret]. Or GH_PAT=[secret]"


def test_fresh_formats_and_plain_tokens(model):
    held = [w for w in secrets.labelled_credentials(20, seed=99) if model.accepts(w)]
    found = sum(any(k != "hex" or len(w) in (40, 64) for _, _, k in secrets.spans(f"KEY={w}.".encode(), model)) for w in held)
    assert found == len(held)
    plain = secrets.labelled_plain(60, seed=98)
    assert sum(bool(formats(w + ".", model)) for w in plain) / len(plain) < 0.03
    assert formats("-".join(["deadbeef"] * 1000) + " " + "x" * 100_000, model) == []


def _drawn(rng):
    import uuid

    digits = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    return {"uuid": str(uuid.UUID(int=rng.getrandbits(128), version=4)), "trace": digits(16), "short digest": digits(20), "groups": "-".join(digits(4) for _ in range(5))}


@pytest.mark.parametrize("learned", [False, True])
def test_ordinary_identifiers_are_no_secrets(spark, model, learned):
    import random

    rng = random.Random(21)
    if learned:
        texts = [(i, f"id {_drawn(rng)['uuid']} trace {_drawn(rng)['trace']} secret={''.join(rng.choices('abcdef0123456789', k=20))}") for i in range(300)]
        model = secrets.learn(spark.createDataFrame(texts, "doc_id long, text string"))
    wrong = {k: 0 for k in _drawn(rng)}
    for _ in range(300):
        for k, w in _drawn(rng).items():
            wrong[k] += bool(formats(f"see {w} here", model))
    if learned:
        wrong.pop("short digest")  # labelled as secrets there
    assert max(wrong.values()) <= 3, wrong


def test_fresh_credentials_of_every_format(model):
    found, all_ = {}, {}
    for w in secrets.labelled_credentials(200, seed=77):
        head = w[:4] if w[:4] in model.heads else "hex"
        all_[head] = all_.get(head, 0) + 1
        found[head] = found.get(head, 0) + bool(secrets.spans(f"see {w} here".encode(), model))
    assert all_.keys() == {"AKIA", "ghp_", "xoxb", "AIza", "sk_l", "hex"}
    assert all(found[k] >= 0.95 * n for k, n in all_.items()), (found, all_)
    # A length that no example has is another thing.
    assert formats("AIza" + "b" * 3 + "Sy7dQ2mXw9K", model) == []


def test_every_token_of_the_corpus_counts(spark):
    import random

    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    rows = [(f"token=zq9_{''.join(rng.choices('XYZW0123456789', k=23 if i == 700 else 20))} {letters(20)}.",) for i in range(1500)]
    mine = secrets.learn(spark.createDataFrame(rows, "text string").repartition(7))
    # All labelled and all plain tokens weigh as much as 300; one among 1,500 counts as such.
    assert mine.formats["zq9_"].lengths == pytest.approx({24: 300 * 1499 / 1500, 27: 300 / 1500})
    assert sum(f.words for f in mine.formats.values()) == pytest.approx(300 + len(secrets.labelled_credentials()))
    assert mine.plain.total[0] == pytest.approx(300 + len(secrets.labelled_plain() + secrets.labelled_ids()))
    assert sum(mine.accepts(r[0].rpartition(" ")[2]) for r in rows) <= 1
