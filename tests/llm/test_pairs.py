import numpy as np
import pytest

from siftloom.functions.labels import DOMAINS
from siftloom.llm import pairs
from siftloom.llm.crf import Crf

NAMES = ["Accuracy", "Coherence", "Consistency", "Content", "Novelty", "Focus", "Creativity", "Professionalism", "Style", "Grammar", "Structure", "Originality", "Sensitivity", "Overall Score"]
LIST = " ".join(f"[{k}]{v[0]}" for k, v in DOMAINS.items())
TEXT = "The old mill by the river was sold last spring, and nobody has heard the wheel turn since then."
ALL = f"Rate the following text on fourteen criteria (1 to 5) and name its domain type.\nText: {TEXT}\nDomain Types: {LIST}\nCriteria:\n" + "\n".join(f"[{i + 1}]{n}: _/5" for i, n in enumerate(NAMES))
SCORE = f"Please give one overall score for the text:\nText: {TEXT}\nOverall Score:_/5"
DOMAIN = f"Please name the domain type of the text:\nText: {TEXT}\nDomain Types: {LIST}\nDomain:_"
ZH = "请给出文本的总评分：\n文本：河边的旧磨坊去年春天卖掉了，从此再也没有人听见水车转动的声音。\n总评分:_/5"
FULL = "\n".join(f"[{i + 1}]{n}: {1 + i % 5}/5" for i, n in enumerate(NAMES)) + "\nDomain Type: [J]Culture"

CASES = [
    (ALL, FULL, None), (ALL, FULL + "\n\n" + FULL, None), (ALL, "I cannot verify every claim, but the ratings are as follows.\n" + FULL, None),
    (ALL, FULL.replace("[1]Accuracy: 1/5", "[1]Accuracy: N/A"), None), (ALL, 'The text says: "sold last spring".\n' + FULL, None),
    (ALL, "\n".join(f"{i + 1}. **{n}**: {1 + i % 5}/5 - Terms are clear." for i, n in enumerate(NAMES)) + "\nDomain Type: [A]Medicine", None),
    (ALL, "\n".join(f"| [{i + 1}] {n} | {1 + i % 5}/5 |" for i, n in enumerate(NAMES)) + "\nDomain Type: [A]Medicine", None),
    (ALL, FULL[:120], "truncated"), (ALL, FULL[: -len("\nDomain Type: [J]Culture")], "truncated"), (ALL, FULL[:-3], "truncated"),
    (SCORE, "Overall Score: 4/5", None), (SCORE, "Overall Sc", "truncated"), (DOMAIN, "Domain Type: [J]Culture", None), (DOMAIN, "Dom", "truncated"),
    (ALL, None, "empty"), (ALL, " \n", "empty"), (ALL, "（无）", "empty"), (ALL, "N/A", "empty"), (ALL, "```\n\n```", "empty"), (ALL, "​", "empty"), (SCORE, "...", "empty"),
    (ALL, "I'm sorry, but I can't help with rating this text.", "refusal"), (ALL, "Domain Type: [J]Culture\nSorry, I must decline to score this document.", "refusal"),
    (ZH, "抱歉，我无法对这段文本进行评分。", "refusal"), (SCORE, "Unfortunately, I'm not able to assess this content.\n(The text begins: The old mill by the river)", "refusal"),
    (ALL, TEXT, "copies_question"), (ALL, "Here is the text:\n\n" + TEXT, "copies_question"), (ALL, ALL, "copies_question"), (SCORE, TEXT.lower(), "copies_question"),
    (ALL, FULL.replace("Accuracy", "Точность текста").replace("Domain Type: [J]Culture", "Область: [J]").replace("Overall Score", "Общая оценка"), None),
    (SCORE, "Общая оценка: 3/5", "other_language"), (SCORE, "Note globale: 3/5", "other_language"), (SCORE, "总评分：3/5", "other_language"), (ZH, "Overall Score: 3/5", "other_language"),
    (ZH, "总评分：3/5", None), (DOMAIN, "Fachgebiet: [L]", "other_language"), (SCORE, "Le texte reste clair dans l'ensemble.\nNote globale: 3/5", "other_language"),
]


def frame(spark, cases, status="success"):
    rows = [(i, {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": q}]}, status, a) for i, (q, a, *_) in enumerate(cases)]
    schema = "request_id long, request_json struct<model: string, messages: array<struct<role: string, content: string>>>, status string, gpt_response string"
    return spark.createDataFrame(rows, schema)


EN_WORDS = "river mill wheel harvest market bridge lantern garden storm letter captain orchard village winter signal morning harbour ladder copper meadow basket miller evening window station engine forest valley".split()
EN_VERBS = "carried crossed opened followed repaired watched painted measured gathered answered noticed crowded".split()
ZH_NOUNS = "磨坊 河水 春天 市场 灯笼 花园 风暴 信件 村庄 冬天 港口 梯子 草地 篮子 早晨 火车 森林 山谷".split()
ZH_VERBS = "经过 打开 跟随 修理 观看 测量 收集 回答 注意".split()
ZH_NAMES = "文本准确性 语义连贯性 语种统一性 有效语义内容比例 知识新颖性 主题专注度 创意表达比例 专业程度 风格统一度 语法结构丰富性 结构规范程度 内容不重复度 敏感内容适宜度 总评分".split()
EN_MORE = ["Nobody could verify what had happened, but each claim was written down here.", "They rated the work as fair and gave reasons for their choice.", "Rather than judge too early, we waited until every report arrived.",
           "Some of these questions were never answered, although people asked them again and again.", "She would not say whether the price was right.", "It takes years to learn how the old machines are kept in order.",
           "All that remains is a list of names and a few letters from the first owner.", "You can still see where the water came through the wall."]
REMARKS = {False: ["Terms are clear.", "The wording is plain.", "Sentences are uneven in places.", "The ending is loose."], True: ["用词平实。", "句子清楚。", "结尾略显松散。", "术语前后一致。"]}


def made_rows(n=700, seed=2):
    """(request, complete answer) of both languages in several layouts, and some refusals."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    out = []
    for k in range(n):
        zh = bool(rng.random() < 0.4)
        if zh:
            text = "".join(f"{pick(ZH_NOUNS)}的{pick(ZH_NOUNS)}{pick(ZH_VERBS)}了{pick(ZH_NOUNS)}。" for _ in range(rng.integers(2, 9)))
        else:
            text = " ".join(f"The {pick(EN_WORDS)} by the {pick(EN_WORDS)} {pick(EN_VERBS)} a {pick(EN_WORDS)}, and no {pick(EN_WORDS)} {pick(EN_VERBS)} it. {pick(EN_MORE)}" for _ in range(rng.integers(2, 9)))
        names, letter = (ZH_NAMES if zh else NAMES), pick(list(DOMAINS))
        list_ = " ".join(f"[{x}]{v[zh]}" for x, v in DOMAINS.items())
        score = lambda: f"{rng.integers(1, 6)}/5"
        mark, domain = ("：", "领域类型") if zh else (": ", "Domain Type")
        title = f"{domain}{mark}[{letter}]{DOMAINS[letter][zh]}"
        kind = rng.random()
        if kind < 0.15:
            q = f"请给出文本的总评分：\n文本：{text}\n总评分:_/5" if zh else f"Please give one overall score for the text:\nText: {text}\nOverall Score:_/5"
            a = f"{names[-1]}{mark}{score()}"
            if rng.random() < 0.3:
                a = pick(REMARKS[zh]) + "\n" + a
        elif kind < 0.3:
            q = f"请给出文本的领域类型：\n文本：{text}\n领域类型：{list_}\n领域:_" if zh else f"Please name the domain type of the text:\nText: {text}\nDomain Types: {list_}\nDomain:_"
            a = title
        else:
            head, tail = ("请为下面的文本打出十四项分数并给出领域类型：\n文本：", "\n领域类型：") if zh else ("Rate the following text on fourteen criteria (1 to 5) and name its domain type.\nText: ", "\nDomain Types: ")
            q = f"{head}{text}{tail}{list_}\n" + "\n".join(f"[{i + 1}]{x}{mark}_/5" for i, x in enumerate(names))
            form = pick(["[{i}]{x}{m}{s}", "{i}. **{x}**: {s} - {r}", "| [{i}] {x} | {s} |", "[{i}] {x}{m}{r} **{s}**"])
            lines = [form.format(i=i + 1, x=x, m=mark, s=score(), r=pick(REMARKS[zh])) for i, x in enumerate(names)]
            a = "\n".join([title, *lines] if rng.random() < 0.5 else [*lines, title])
        if rng.random() < 0.03:
            a = "抱歉，我无法为这段文本打分。" if zh else "I'm sorry, but I cannot rate this text."
        out.append((q, a))
    return out


@pytest.fixture(scope="module")
def field():
    return pairs.fit_rows([(a, q) for q, a in made_rows()])


def test_defects(spark, field):
    got = {r.request_id: r.defect for r in pairs.defects(frame(spark, CASES), field).collect()}
    wrong = [(q[:30], a, want, got.get(i)) for i, (q, a, want) in enumerate(CASES) if got.get(i) != want]
    assert not wrong


# None of these stands in the seeds, the trained refusals or the made rows.
HELD_OUT = {
    False: ["I would rather not grade this passage.", "Rating this would go against my instructions.", "No scores will be provided for this document.", "This is a task I will not take on.",
            "I respectfully pass on assessing the passage.", "I must withhold any judgement about this writing.", "My guidelines keep me from scoring material like this."],
    True: ["我不想给这段文字评级。", "我选择不对此文作出评价。", "按照规定，我不会为这样的材料打分。", "对于这篇文章，我不予置评。", "我没有资格评判这份文本。", "我的准则禁止我为此类文本评分。"],
}
OTHER = [("Il testo resta chiaro nel complesso.", "Voto complessivo: 3/5"), ("Tekst jest ogólnie zrozumiały.", "Ocena ogólna: 2/5"), ("Metin genel olarak anlaşılır.", "Genel puan: 4/5"),
         ("文章は全体としてわかりやすいです。", "総合評価：3/5"), ("글이 전반적으로 명확합니다.", "종합 점수: 4/5"), ("Текст в целом понятен.", "Общая оценка: 3/5")]


def test_held_out_wordings(field):
    """Refusals and languages the field was not fitted on, cuts anywhere, changed copies: recall and precision of each at least 0.95."""
    rng = np.random.default_rng(9)
    cases = []
    for n, (q, a) in enumerate(made_rows(900, seed=31)):
        asked = pairs.Request(q)
        if pairs.given(a, asked) < 1:
            continue
        if n % 5 == 0:
            said = HELD_OUT[asked.chinese]
            cases.append((q, said[int(rng.integers(len(said)))], "refusal"))
        elif n % 5 == 1 and asked.n_scores == 1:
            cases.append((q, "\n".join(OTHER[int(rng.integers(len(OTHER)))]), "other_language"))
        elif n % 5 == 1 and asked.n_scores == 14:
            s, _ = OTHER[int(rng.integers(len(OTHER)))]
            cases.append((q, "\n".join(f"[{i}] {s.strip('.。')}: 3/5" for i in range(1, 15)) + "\n" + s[:6] + ": [B]", "other_language"))
        elif n % 5 == 2:
            cut = a[: int(rng.integers(1, len(a)))].rstrip()
            if pairs.given(cut, asked) < 1 and pairs.plain(cut) not in pairs.NO_VALUE:
                cases.append((q, cut, "truncated"))
        elif n % 5 == 3:
            parts = list(asked.text) if asked.chinese else asked.text.split(" ")
            parts = [parts[int(rng.integers(len(parts)))] if rng.random() < 0.04 else x for x in parts]
            cases.append((q, ("" if asked.chinese else " ").join(parts), "copies_question"))
        else:
            lead = "这段文字我无法全部核实，但评分如下。\n" if asked.chinese else "I cannot verify each claim, but here are the ratings.\n"
            cases.append((q, lead + a if n % 2 else a, None))
    judged = field.judge([a for _, a, _ in cases], [q for q, _, _ in cases])
    got = [pairs.decide(j[0], j[1]) for j in judged]
    for kind in ("refusal", "other_language", "truncated", "copies_question", None):
        wanted, told = [c[2] == kind for c in cases], [g == kind for g in got]
        both = sum(x and y for x, y in zip(wanted, told))
        assert both >= 0.95 * sum(wanted) and both >= 0.95 * sum(told), (kind, [(c[1][:80], g) for c, g in zip(cases, got) if (c[2] == kind) != (g == kind)][:5])


def test_the_field_decides(field):
    """The rules that labelled the training rows, put in place of the tags, give other answers."""
    rows = [(q, "I would rather not grade this passage.") for q, _ in made_rows(20, seed=4) if not pairs.Request(q).chinese]
    judged = field.judge([a for _, a in rows], [q for q, _ in rows])
    assert all(pairs.decide(j[0], j[1]) == "refusal" for j in judged) and not any(pairs.SEEDS.search(a) for _, a in rows)


def test_long_responses_are_fitted_in_pieces(field):
    """A truncated answer behind hundreds of clauses is still found, and fitting takes such rows."""
    long = ("The mill was sold. " * 200) + FULL
    rows = [(a, q) for q, a in made_rows(60)] + [(long, ALL)] * 5
    again = pairs.fit_rows(rows)
    assert len(again.judge([long], [ALL])[0][0]) > 200
    assert pairs.decide(*field.judge([("Terms are clear. " * 100) + FULL[:150]], [ALL])[0][:2]) == "truncated"


def test_tiny_and_empty_samples(spark):
    assert pairs.defects(frame(spark, []), None).count() == 0
    only = [(ALL, None, "empty"), (ALL, "", "empty")]
    assert {r.defect for r in pairs.defects(frame(spark, only)).collect()} == {"empty"}
    assert pairs.fit_rows([]).judge(["4/5"], [SCORE])[0] is not None


def test_other_rows(spark, field):
    assert pairs.defects(frame(spark, CASES, "failed"), field).count() == 0
    assert pairs.defects(frame(spark, CASES).where("false")).count() == 0
    bare = spark.createDataFrame([(1, None, "success", "text", "x"), (2, {"messages": []}, "success", None, "x"), (3, {"messages": None}, "success", "a" * 100_000, "x")],
                                 "request_id long, request_json struct<messages: array<struct<role: string, content: string>>>, status string, gpt_response string, content string")
    assert [tuple(r) for r in pairs.defects(bare.select("request_id", "request_json", "status", "gpt_response"), field).collect()] == [(2, "empty")]
    cover = pairs.coverage(frame(spark, CASES), field).collect()
    assert len(cover) == len(CASES) and all(abs(r.answer + r.refusal + r.echo + r.foreign + r.unfinished - 1) < 1e-6 or r.n_clauses == 0 for r in cover)


def test_field_learns_held_out_sequences():
    """Labels follow the feature except after label 2, which always gives 0."""
    rng = np.random.default_rng(3)

    def sample(n):
        xs, ys = [], []
        for _ in range(n):
            k = rng.integers(1, 9)
            f = rng.integers(0, 3, k)
            y = f.copy()
            for i in range(1, k):
                if y[i - 1] == 2:
                    y[i] = 0
            xs.append([[int(x)] for x in f])
            ys.append(y)
        return xs, ys

    crf = Crf(3, 3).fit(*sample(400), steps=120)
    x, y = sample(300)
    right = np.concatenate([a == b for a, b in zip(crf.tag(x), y)])
    assert right.mean() > 0.98
    assert [len(t) for t in crf.tag([[], x[0]])] == [0, len(x[0])]


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    crf = Crf(4, 3)
    crf.w, crf.t, crf.s = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    rows = [[[0, *(f for f in range(1, 4) if rng.random() < 0.5)] for _ in range(k)] for k in (1, 2, 4, 5)]
    for r, tags in zip(rows, crf.tag(rows)):
        e = np.array([crf.w[s].sum(0) for s in r])
        value = lambda p: crf.s[p[0]] + sum(e[i, a] for i, a in enumerate(p)) + sum(crf.t[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        assert value(tags) == pytest.approx(max(value(p) for p in product(range(3), repeat=len(r))))


def test_every_row_is_fitted(spark):
    """A table of more rows than a sample would hold, one of them very long: the same field as from all of its rows in memory."""
    short = [(a, q) for q, a in made_rows(200, seed=8) if len(a) + len(q) < 600]
    rows = [short[i % len(short)] for i in range(4000)] + [(FULL, ALL.replace(TEXT, "Quizzical zephyrs vex. " * 1200))]
    kept = pairs.fit_rows(rows)
    table = frame(spark, [(q, a) for a, q in rows]).repartition(3)
    fitted = pairs.fit(table)
    for name in ("_own", "_like", "words"):
        assert np.array_equal(*(np.array(sorted(x) if isinstance(x, frozenset) else x) for x in (getattr(f.reader, name) for f in (fitted, kept))))
    assert np.abs(fitted.crf.w - kept.crf.w).max() < 1e-3 and np.abs(fitted.crf.t - kept.crf.t).max() < 1e-3
    assert {pairs._fold(w) for w in ("quizzical", "zephyrs", "vex")} <= pairs.fit_rows(rows[-80:]).reader.words


def test_made_rows_depend_on_their_row_alone():
    rows = pairs._ready([(a, q) for q, a in made_rows(80, seed=6)])
    counts = pairs.Counts()
    pairs.count_requests(rows, counts)
    requests = counts.flush()
    judge = pairs.Judge(pairs._letters_of(*requests))
    judge.trim(judge.count(rows))
    pairs.count_answers(rows, judge, counts)
    reader = pairs._reader(judge.own, requests, counts.flush(), len(rows))
    whole = [pairs._packed(x, y) for x, y in pairs.training(rows, judge, reader)]
    assert whole == [pairs._packed(x, y) for r in rows for x, y in pairs.training([r], judge, reader)]
    assert all(pairs._packed(*pairs._unpacked(k)) == k for k in whole)
    assert {y for k in whole for y in pairs._unpacked(k)[1]} == set(range(5))


def test_clauses_that_come_again_are_read_once(monkeypatch, field):
    """The letters of fifty equal answers cost as much as those of one; features are the same whether clauses are known or not."""
    read, grams = [], pairs._grams
    monkeypatch.setattr(pairs, "_grams", lambda text: read.append(len(text)) or grams(text))
    rows = [(FULL, pairs.Request(ALL), 1.0)] * 50 + [(FULL[:120], pairs.Request(ALL), 0.2), ("Общая оценка: 3/5", pairs.Request(ZH), 1.0)]
    fresh = lambda: pairs.Reader(*({zh: pairs.Letters(np.arange(1 << pairs._BUCKETS) % 7 * (1 + zh)) for zh in (False, True)} for _ in range(2)), field.reader.words)
    reader = fresh()
    got = reader.features(rows)
    assert sum(read) < 2 * len(FULL)
    assert got == reader.features(rows) == [fresh().features([r])[0] for r in rows]


@pytest.mark.parametrize("groups", [None, np.array([0, 0, 1, 1, 2, 2])])
def test_slope_equals_enumeration(groups):
    """The slope is that of the likelihood, also where equal parts of steps are summed once and some steps lack a part."""
    from itertools import product

    from siftloom.llm.crf import chunk

    rng = np.random.default_rng(7)
    rows = [[sorted({int(rng.integers(2)), *(f for f in range(2, 6) if rng.random() < 0.4)}) for _ in range(k)] for k in (1, 4, 2, 3, 4, 1)]
    labels, weights = [rng.integers(0, 3, len(r)).tolist() for r in rows], [1.0, 2.0, 0.5, 1.0, 3.0, 1.0]
    crf = Crf(6, 3)
    crf.w, crf.t, crf.s = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)

    def likelihood():
        total = 0.0
        for r, y, weight in zip(rows, labels, weights):
            value = lambda p: crf.s[p[0]] + sum(crf.w[s, a].sum() for s, a in zip(r, p)) + sum(crf.t[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
            total += weight * (value(y) - np.log(sum(np.exp(value(p)) for p in product(range(3), repeat=len(r)))))
        return total

    want = []
    for p in (crf.w, crf.t, crf.s):
        for i in np.ndindex(p.shape):
            p[i] += 1e-5
            above = likelihood()
            p[i] -= 2e-5
            want.append((above - likelihood()) / 2e-5)
            p[i] += 1e-5
    one = chunk(rows, labels, weights, *([] if groups is None else [groups]))
    assert crf.slope(one) == pytest.approx([*want, sum(weights)], abs=1e-6)
    if groups is not None:
        parts = [{tuple(f for f in s if groups[f] == g) for r in rows for s in r} - {()} for g in range(3)]
        assert [len(p.start) for p in one.parts] == [len(p) for p in parts]
