import random
import re

from probanda.llm import personal_data as p

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and p.luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def test_base_is_the_patterns_leftmost_matches():
    r = random.Random(2)
    for alphabet in ("a@.-_ 1", "12.3 @a", "0123456789 -", "+12 ().-3", "4 -"):
        for _ in range(1500):
            text = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
            assert p.base_spans(text) == plain(text), text
    assert p.luhn("4111111111111111") and not p.luhn("4111111111111112")
    assert p.base_spans("9" * 50_000) == [] and p.base_spans("a" * 200_000 + "@") == []


def test_field_finds_other_forms_and_leaves_clean_lines():
    field, hit, wrong, missed = p.Field(p.learnt_weights()), 0, 0, 0
    for text, gold in p.generated_lines(200, seed=77):
        got, gold = set(field.best(text, [m.span() for m in p.TOKEN.finditer(text)])), set(gold)
        hit, wrong, missed = hit + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.8
    for clean in ("in 1999 and 2004 there were 12,345,678 of them", "version 2.0.1 at the end of 2020-01-02", 'token = "ce0cc631f6559e745b37cb8be6fc63ae2d235c5f" that'):
        assert p.personal_spans(clean, field) == ([], [])


def test_best_segmentation_is_the_best_of_all():
    field = p.Field(p.learnt_weights())
    text = "call 555 123 4567 or 1 2 3 4"
    tokens = [m.span() for m in p.TOKEN.finditer(text)]
    ends = field.candidates(text, tokens)

    def best(j):
        return 0.0 if j == 0 else max([best(j - 1), *(best(i) + s for i, _, _, s in ends[j])])

    at = {t: i for i, t in enumerate(tokens)}
    score = sum(s for kind, a, b in field.best(text, tokens) for j in range(1, len(ends)) if tokens[j - 1][1] == b for i, k, _, s in ends[j] if k == kind and tokens[i][0] == a)
    assert at and abs(score - best(len(tokens))) < 1e-9


def test_table(edges, nothing):
    rows = {r["doc_id"]: r for r in p.personal_data(edges).collect()}
    assert rows[12]["n_email"] == 1 and rows[12]["n_phone"] == 1 and rows[0]["spans"] == "" and len(rows) == 14
    assert p.personal_data(nothing).count() == 0
    masked = p.masked_documents(edges)
    assert masked.columns == edges.columns
    r = masked.where("doc_id = 12").first()
    assert "[EMAIL]" in r["text"] and "[PHONE]" in r["text"] and r["n_chars"] == len(r["text"])
    assert masked.where("doc_id = 0").first()["text"] is None


def test_each_address_form_is_found_whole():
    field = p.Field(p.learnt_weights())
    people, hosts = ("john", "mary.smith", "thonin45", "erin.quti", "anreti"), (("mail", "com"), ("post7", "org"), ("lequ", "net"))
    for form in ("{}@{}.{}", "{} at {} dot {}", "{} (at) {} (dot) {}", "{}[at]{}.{}", "{} AT {} DOT {}", "{} (AT) {} (DOT) {}", "{}[AT]{}.{}", "{} at {}.{}"):
        found = []
        for before in ("please write to ", "in the morning contact: ", "therin ti "):
            for a in people:
                for b, c in hosts:
                    e = form.format(a, b, c)
                    found.append(("email", len(before), len(before) + len(e)) in p.personal_spans(f"{before}{e} for more words here", field)[1])
        assert sum(found) / len(found) > 0.9, form


def test_spans_do_not_depend_on_their_place():
    field = p.Field(p.learnt_weights())
    tail = " write to jo.do (at) mail (dot) com, or call (743) 555-3824; " + "q" * 300 + ",(743) 555-3824,x"
    want = [(k, s, e) for k, s, e in p.personal_spans(tail, field)[1]]
    assert len(want) >= 2
    for k in (1, 79, 80, 81, *range(4000, 4110, 3), 8190):
        for pad in ("z" * k, "z " * (k // 2)):
            assert p.personal_spans(pad + tail, field)[1] == [(kind, s + len(pad), e + len(pad)) for kind, s, e in want]


def test_windows_of_long_runs_are_apart():
    text = ("7" + "x" * 500) * 2000 + " " + "y " * 300 + "a@b" + " z" * 100
    found = list(p.windows(text))
    assert found[0] == (0, text.index(" ")) or found[0][1] >= text.index(" ")
    assert all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False)) and found[-1][0] < text.index("@") < found[-1][1]
