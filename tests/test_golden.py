"""Before and after pairs, and steps that leave their own output alone."""

import pytest
from pyspark.sql import functions as F

from notewright.functions import formulas, links, spacing, tags, typeset
from notewright.operators import chat, forum, images


def run(spark, cases, change, frame=False):
    """``change`` of each text, and that it leaves its own output alone. With ``frame`` it takes and gives a table."""

    def changed(df):
        return change(df).withColumnRenamed("text", "out") if frame else df.select("i", change(F.col("text")).alias("out"))

    rows = [(i, before) for i, (before, _) in enumerate(cases)]
    got = dict(changed(spark.createDataFrame(rows, "i int, text string")).collect())
    for i, (before, after) in enumerate(cases):
        assert got[i] == after, f"{before!r}: {got[i]!r}, not {after!r}"
    again = changed(spark.createDataFrame([(i, got[i]) for i in got], "i int, text string"))
    assert dict(again.collect()) == got


def test_indents(spark):
    run(spark, [(" \tmessage", "\tmessage"), ("\t\t message", "\t\tmessage"), ("    message", "\tmessage"), ("  message", "message"), ("  - sub item", "  - sub item"), ("- item\n\n  paragraph", "- item\n\n  paragraph"), ("```\n  code\n```", "```\n  code\n```"), ("---\n  a: b\n---", "---\n  a: b\n---"), ("", ""), (None, None)], typeset.fix_indent)


def test_markers(spark):
    run(spark, [(" >quote", "> quote"), (">>quote", "> > quote"), (">[!note] title", "> [!note] title"), ("-    item", "- item"), ("1)   item", "1) item"), ("##   heading", "## heading"), ("#tag", "#tag"), (">   - nested", ">   - nested"), ("- item\n  > quote", "- item\n  > quote"), (None, None)], typeset.fix_markers)


def test_lists(spark):
    run(spark, [("3. a\n4. b", "1. a\n2. b"), ("2. parent\n\t3. child\n4. parent2", "1. parent\n\t1. child\n2. parent2"), ("1. a\n1. b", "1. a\n1. b"), ("2. a\n\ntext\n\n3. b", "1. a\n\ntext\n\n1. b"), ("3. a\n\n5. b", "1. a\n\n2. b"), ("```\n3. a\n```", "```\n3. a\n```"), ("> 3. a\n> 4. b", "> 1. a\n> 2. b"), ("", "")], typeset.fix_lists)


@pytest.mark.parametrize("before, after", [((1, 4), (1, 2)), ((1, 3, 3), (1, 2, 2)), ((1, 3, 2), (1, 2, 2)), ((2, 5), (2, 3)), ((2, 1, 3), (2, 2, 3))])
def test_headings(spark, before, after):
    text = lambda levels: "\n".join("#" * n + " h" for n in levels)
    run(spark, [(text(before), text(after))], typeset.fix_headings)


def test_blank_lines(spark):
    run(spark, [("a\n \t\nb", "a\n\nb"), ("a\n\u00a0\nb", "a\n\nb"), ("```\n \n```", "```\n \n```")], typeset.fix_blank_lines)


def test_image_sizes(spark):
    run(spark, [("![[photo.png]]", "![[photo.png|100]]"), ("![[photo.png|300]]", "![[photo.png|100]]"), ("![[photo.png|300x200]]", "![[photo.png|100]]"), ("![[photo.png#outline]]", "![[photo.png#outline|100]]"), ("![](https://x.com/a.jpg)", "![100](https://x.com/a.jpg)"), ("![[photo.png|a caption]]", "![[photo.png|a caption]]"), ("![[notes.md]]", "![[notes.md]]"), ("| a |\n|---|\n| ![[image.png\\|50]] |", "| a |\n|---|\n| ![[image.png\\|100]] |")], lambda t: links.sized_links(t, "100"))
    run(spark, [("x ![[photo.png|300]] y", "x ![[photo.png]] y"), ("![300](a.png)", "![](a.png)")], lambda t: links.sized_links(t, ""))


def test_size_argument():
    assert links.size_argument("100") == "100" and links.size_argument("100", "50") == "100x50"
    for bad in (("a",), ("0",), ("", "5")):
        with pytest.raises(ValueError):
            links.size_argument(*bad)


def test_tags(spark):
    run(spark, [("#math today I studied limits", "today I studied limits #math"), ("today I studied #math limits", "today I studied limits #math"), ("a sentence #note.", "a sentence. #note"), ("- #tag item text", "- item text #tag"), ("> #tag quoted text", "> quoted text #tag"), ("| #tag cell | other |", "| cell #tag | other |"), ("#tag", "#tag"), ("text #math #note", "text #math #note"), ("C# and #123", "C# and #123"), ("`#code` x", "`#code` x"), ("[[note#heading]] x", "[[note#heading]] x")], tags.tag_layout)


def test_spacing(spark):
    cases = [("用anki卡片记笔记", "用 anki 卡片记笔记"), ("第 3 章", "第3章"), ("用GPT4写代码", "用 GPT4 写代码"), ("设$x$为未知数", "设 $x$ 为未知数"), ("中文 ，内容 。", "中文，内容。"), ("元素: $A$", "元素：$A$"), ("第一章矩阵", "第一章 矩阵"), ("第一章、矩阵", "第一章、矩阵"), ("中文**English**中文", "中文 **English** 中文"), ("**可逆矩阵**$P$", "**可逆矩阵** $P$"), ("甲 & 乙", "甲&乙"), ("`code`中文", "`code` 中文"), ("《新 吊带袜天使》", "《新 吊带袜天使》"), ("A & B", "A & B"), ("word,word", "word, word"), ("1.2.2 12:30 a", "1.2.2 12:30 a"), ("```\n用anki\n```", "```\n用anki\n```"), (None, None)]
    run(spark, cases, spacing.fix_spacing, frame=True)


def test_variables_and_symbols(spark):
    change = lambda t: formulas.wrap_variables(t, formulas.declared(t))
    run(spark, [("$z$\n讨论 z 的模长", "$z$\n讨论 $z$ 的模长"), ("$$z = a + bi$$\n因此 z 的实部", "$$z = a + bi$$\n因此 $z$ 的实部"), ("`$z$`\n讨论 z 的", "`$z$`\n讨论 z 的"), ("$z$ the value z is", "$z$ the value z is"), ("$z$\n讨论 Z 的", "$z$\n讨论 Z 的")], change)
    run(spark, [("特征值 λ", "特征值$\\lambda$"), ("$λx$", "$\\lambda x$"), ("plain", "plain")], formulas.symbols_to_commands)


def one_note(spark, text):
    return spark.createDataFrame([(1, "f", text)], "note_id long, folder string, text string")


def test_chat_render(spark):
    out = chat.render_chat(one_note(spark, "张三 2024/1/5 14:30:25你好，文件收到了吗"), "2024-06-01").first()
    assert out["new_text"] == "张三: 2024/01/05 14:30:25\n\t你好，文件收到了吗\n"
    again = chat.render_chat(one_note(spark, out["new_text"]), "2024-06-01").first()
    assert again["new_text"] == out["new_text"]


def test_chat_order_and_merge(spark):
    text = "a 2024/1/5 19:41:38\n![[x.png]]\n\na 2024/1/5 19:41:37\ntext\n\nb 2024/1/5 19:41:39\nend\n"
    msgs = chat.time_ordered(chat.messages(one_note(spark, text), "2024-06-01"))
    rows = [r["time"] for r in msgs.orderBy("place").collect()]
    assert rows == ["19:41:37", "19:41:38", "19:41:39"]
    merged = chat.merged_senders(msgs, "place").orderBy("place").collect()
    assert [(r["user"], r["n_messages"], r["body"]) for r in merged] == [("a", 2, ["text", "![[x.png]]"]), ("b", 1, ["end"])]


def test_mixed_dates_keep_their_order(spark):
    text = "a 2024/1/5 19:41:38\nx\n\nb 19:41:37\ny\n"
    msgs = chat.time_ordered(chat.messages(one_note(spark, text), "2024-06-01")).orderBy("place").collect()
    assert [r["user"] for r in msgs] == ["a", "b"]
    assert msgs[1]["date"] == "2024/06/01" and not msgs[1]["has_date"]


def test_is_chat_log(spark):
    cases = [("张三 2024/1/5 14:30:25你好", True), ("会议 14:30:25 开始", False), ("张三 14:30:25\n你好", True), ("", False), (None, False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string").select("i", chat.is_chat_log(F.col("text")).alias("x"))
    assert dict(df.collect()) == {i: x for i, (_, x) in enumerate(cases)}


def test_mentions(spark):
    cases = [("@徐晃何许人也 这才叫邪恶反派", ["这才叫邪恶反派"]), ("你说的对 @张三 就是这样", ["你说的对 就是这样"]), ("@张三 @李四 大家好", ["大家好"]), ("＠张三 大家好", ["大家好"]), ("发到 foo@bar.com 就行", ["发到 foo@bar.com 就行"]), ("@张三", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", chat.without_mentions(F.array("t")).alias("x"))
    assert dict(df.collect()) == {i: x for i, (_, x) in enumerate(cases)}


def test_forum_floors(spark):
    text = "title\n#1 - 2025-9-15 20:26\n...\n张三 (签名)\n第一楼\n第二行\n3\n5\n收集\n#1-1 - 2025-9-15 20:30\n李四\n回\n回复\n#2 - 2025-9-16 1:05\n回复\n"
    rows = forum.floors(spark.createDataFrame([(1, text)], "topic long, text string")).orderBy("seq").collect()
    assert [(r["floor"], r["post_date"], r["user"], r["signature"], r["body"]) for r in rows] == [("1", "2025-09-15 20:26", "张三", "签名", "第一楼\n第二行"), ("1-1", "2025-09-15 20:30", "李四", "", "回")]


def test_html(spark):
    page = '<h1><a>g</a><br>Title &amp; more</h1><div id="post_1" class="postTopic"><a>#1</a> - 2025-9-15 20:26<a href="/user/u1" class="l">U</a><span class="tip_j">(s)</span><div class="topic_content">a<div>b</div>&#60;c<br>d</div><div>x</div></div><div id="post_2" class="sub_reply_bg"><a>#1-1</a> - 2025-9-15 20:27<a href="/user/u2" class="l">V</a><div class="cmt_sub_content">e</div></div>'
    rows = forum.html_posts(spark.createDataFrame([(1, 1, page)], "topic long, page int, html string")).orderBy("seq").collect()
    assert [(r["kind"], r["floor"], r["user"], r["signature"], r["body"]) for r in rows] == [("topic", "1", "U", "s", rows[0]["body"]), ("sub", "1-1", "V", "", "e")]
    assert "<c" in rows[0]["body"] and "x" not in rows[0]["body"]
    md = forum.html_to_markdown(spark.createDataFrame([(1, "<p>a <b>b</b> <a href='u'>l</a><br>x &amp; &#20013;</p>")], "i int, html string")).first()
    assert md["markdown"] == "a **b** [l](u)\nx & 中"


def test_names(spark):
    cases = [("Q)\\TN.gif", True), ("%01.png", True), ("123.456.jpg", True), ("photo.png", False), ("Pasted image 20260420123045.png", False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", images.is_garbled(F.col("t")).alias("x"))
    assert dict(df.collect()) == {i: x for i, (_, x) in enumerate(cases)}
    row = spark.createDataFrame([("a/b: c?.",)], "t string").select(images.safe_name(F.col("t"))).first()
    assert row[0] == "a b c"


def test_all_symbols(spark):
    assert len(formulas.SYMBOLS) == 34 + 31
    run(spark, [("设 $ζx ± ∑ ⊂ ← Ψ$，值", "设 $\\zeta x \\pm \\sum \\subset \\leftarrow \\Psi$，值")], formulas.symbols_to_commands)


def test_widths_by_sentence(spark):
    cases = [("中文内容。Hello world，good day", "中文内容。Hello world, good day"), ("Hello big world。中文，内容", "Hello big world。中文，内容"), ("One line，of words。And more words！", "One line, of words. And more words!"), ("参数 gain=50、shift=0", "参数 gain=50、shift=0"), ("没有 $M_{ij}$, 且", "没有 $M_{ij}$，且"), ("中文;英文", "中文；英文"), ("好?不", "好？不"), ("1,000个", "1,000个"), ("时间12:30到", "时间12:30到"), ("中文/, 好", "中文/, 好")]
    run(spark, cases, spacing.fix_spacing, frame=True)


def test_protected_text_keeps_every_mark(spark):
    kept = ["`f(中,文)`", "[[笔记,甲]]", "![[图:一,二.png]]", "[说明](a/中,文.md)", "$x中,文$", "《书,名》", "“引,文”", "张三: 2024/01/05 14:30:25", "%%注,释%%", "<a title=中,文>", "[^注,一]", "$$中,文$$", "```\n中,文 a中\n```", "| 中,文 | a中 |\n|---|---|\n| 甲,乙 | b乙 |", "---\na: 中,文\n---", "$$\n中,文\n$$", "x\r", "\u2028x\u0085y \u2028"]
    run(spark, [(t, t) for t in kept], spacing.fix_spacing, frame=True)


def test_symbols_and_wrappers(spark):
    cases = [("中文 ，内容 。", "中文，内容。"), ("word,word", "word, word"), ("如, ：", "如,："), ("7. 并列：&", "7. 并列：&"), ("甲 & 乙", "甲&乙"), ("甲 | 乙", "甲|乙"), ("甲 → 乙", "甲→乙"), ("A & B", "A & B"), ("$A$ & $B$", "$A$ & $B$"), ("word, word", "word, word"), ("（ + ）", "（+）"), ('" + "', '"+"'), ("《 书名 》", "《书名》"), ("《新 吊带袜天使》", "《新 吊带袜天使》"), ("x ^ 2", "x^2"), ("等等 ... 内容", "等等...内容"), ("( x )", "(x)"), ("中文 (说明)", "中文(说明)"), ("f (x)", "f(x)"), ("an (aside) here", "an (aside) here"), ("|x|", "|x|"), ("P(A|B)", "P(A|B)"), ("x || y", "x || y"), ("e.g. this", "e.g. this"), ("Q&A", "Q&A"), ("ctrl+c", "ctrl+c"), ("1.2.2 and 12:30", "1.2.2 and 12:30"), ('say "hi there" now', 'say "hi there" now'), ('说 "好" 了', '说"好"了')]
    run(spark, cases, spacing.fix_spacing, frame=True)


def test_emphasis_is_looked_past(spark):
    cases = [("**可逆矩阵**$P$", "**可逆矩阵** $P$"), ("中文**English**中文", "中文 **English** 中文"), ("~~旧~~new", "~~旧~~ new"), ("甲***abc***乙", "甲 ***abc*** 乙"), ("**中_abc_文**x", "**中 _abc_ 文** x"), ("2*3", "2*3"), ("a*b", "a*b")]
    run(spark, cases, spacing.fix_spacing, frame=True)


def test_units(spark):
    units = lambda df: spacing.fix_spacing(df, spacing.SpacingOptions(digit_unit=True))
    run(spark, [("长100 kg的", "长 100 kg 的"), ("共 5 fps 呢", "共 5 fps 呢"), ("100kg", "100 kg"), ("1.5mm", "1.5 mm"), ("20℃", "20 ℃"), ("3D打印", "3D 打印"), ("4K", "4K")], units, frame=True)


def test_protected_spans_do_not_overlap(spark):
    text = "`https://a.b/c` [x](http://y.z/a) <b> me@x.org, localhost:80 a.bc &amp; #tag %%c `d`%% [^1]"
    df = spark.createDataFrame([(1, text), (2, "```\n`x`\n```"), (3, None), (4, "")], "note_id long, text string")
    rows = spacing.protected_spans(df).orderBy("note_id", "line", "ord").collect()
    assert [(r["kind"], r["span"]) for r in rows] == [("code", "`https://a.b/c`"), ("link", "[x](http://y.z/a)"), ("html", "<b>"), ("email", "me@x.org"), ("host_port", "localhost:80"), ("domain", "a.bc"), ("entity", "&amp;"), ("tag", "#tag"), ("comment", "%%c `d`%%"), ("footnote", "[^1]")]
    assert all(r["note_id"] == 1 and text[r["start"] : r["end"]] == r["span"] for r in rows) and [r["ord"] for r in rows] == list(range(10))


def test_tags_of_a_paragraph(spark):
    cases = [("one #x\ntwo text", "one\ntwo text #x"), ("> a #x\n> b #y\nc #z", "> a\n> b #x #y\nc #z"), ("#x\ntext", "\ntext #x"), ("text\n#x", "text\n#x"), ("#b\n#a", "#b\n#a"), ("a #x\n\nb", "a #x\n\nb"), ("- a #x b\n- c", "- a b #x\n- c"), ("a #x\n# h\nb", "a #x\n# h\nb"), ("a #x\n```\n#c d\n```", "a #x\n```\n#c d\n```")]
    run(spark, cases, tags.tag_layout)


def test_topic_addresses(spark):
    cases = [("https://bgm.tv/group/topic/12", ("group", 12)), ("m.bangumi.tv/subject/topic/3/", ("subject", 3)), ("http://WWW.bgm.tv/group/topic/4?page=2#x", ("group", 4)), ("https://chii.in/group/topic/5", None), ("https://bgm.tv/group/topic/6/x", None), ("https://x.org/group/topic/7", None), (None, None)]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, u string").select("i", forum.topic_url(F.col("u")).alias("t"))
    assert {r["i"]: r["t"] and (r["t"]["kind"], r["t"]["id"]) for r in df.collect()} == {i: x for i, (_, x) in enumerate(cases)}


def test_collated_numbers_of_any_length(spark):
    names = ["note 9", "note 10", "note 0010b", "Note 123456789012345", "note 1234567890123456", "note 99999999999999999999999"]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "t string").orderBy(tags.collation_key(F.col("t")))
    assert [r["t"] for r in df.collect()] == names
