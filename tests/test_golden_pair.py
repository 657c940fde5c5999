"""End-to-end golden pair: a raw Russian news article and its processed form
(lower-cased, cleaned, lemmatized, stop words and punctuation removed).

The fixture lexicon is the hand-aligned surface form -> lemma list for that
article (forms equal to their lemma are left out: no entry means identity).
With lemmas looked up before the stop-word filter, Spark ML's Russian list
drops the same words the processed article lacks.
"""

from precis.operators.corpus import records_to_pairs

# Test fixture: the raw article and its processed form.
RAW = (
    'Президент Сирии Башар Асад рассказал в интервью РИА Новости и телеканалу "Россия 24" о '
    'том, как Дамаск расценивает российско-турецкий меморандум по ситуации на севере страны, '
    'как выполняются эти договоренности. Он также сообщил, как идет диалог сирийских властей '
    'с курдами и кто этому мешает, что делается для возвращения в страну беженцев и как '
    'вернуть курдское население к нормальной мирной жизни в Сирии. Асад поделился своим '
    'мнением о том, почему США воруют сирийскую нефть, что в связи с этим будет делать '
    'Дамаск, а также рассказал, кому могла быть выгодна гибель одного из основателей '
    'организации "Белые каски" Джеймса Ле Мезюрье\n'
)
GOLD = (
    'президент сирия башар асад рассказывать интервью риа новость телеканал россия 24 дамаск '
    'расценивать российско турецкий меморандум ситуация север страна выполняться '
    'договоренность также сообщать идти диалог сирийский власть курд это мешать делаться '
    'возвращение страна беженец вернуть курдский население нормальный мирный жизнь сирия '
    'асад поделиться свой мнение почему сша воровать сирийский нефть связь это делать дамаск '
    'также рассказывать мочь выгодный гибель основатель организация белый каска джеймс ле '
    'мезюрье'
)

# Test fixture: surface form -> lemma for the golden article.
LEXICON = [
    ("сирии", "сирия"), ("рассказал", "рассказывать"), ("новости", "новость"),
    ("телеканалу", "телеканал"), ("том", "тот"), ("расценивает", "расценивать"),
    ("ситуации", "ситуация"), ("севере", "север"), ("страны", "страна"),
    ("выполняются", "выполняться"), ("эти", "этот"), ("договоренности", "договоренность"),
    ("сообщил", "сообщать"), ("идет", "идти"), ("сирийских", "сирийский"),
    ("властей", "власть"), ("курдами", "курд"), ("этому", "это"), ("мешает", "мешать"),
    ("делается", "делаться"), ("возвращения", "возвращение"), ("страну", "страна"),
    ("беженцев", "беженец"), ("курдское", "курдский"), ("нормальной", "нормальный"),
    ("мирной", "мирный"), ("жизни", "жизнь"), ("поделился", "поделиться"),
    ("своим", "свой"), ("мнением", "мнение"), ("воруют", "воровать"),
    ("сирийскую", "сирийский"), ("связи", "связь"), ("этим", "это"), ("будет", "быть"),
    ("кому", "кто"), ("могла", "мочь"), ("выгодна", "выгодный"), ("одного", "один"),
    ("основателей", "основатель"), ("организации", "организация"), ("белые", "белый"),
    ("каски", "каска"), ("джеймса", "джеймс"),
]


def test_golden_article(spark):
    raw, gold = RAW, GOLD
    df = spark.createDataFrame([(0, raw, "")], "id long, text string, title string")
    lex = spark.createDataFrame(LEXICON, "form string, lemma string")
    art = records_to_pairs(df, lexicon=lex, language="russian").first()["article"]
    assert art.split() == gold.split()
    # without lemmas, surface stop words are removed but inflected ones stay
    plain = records_to_pairs(df, language="russian").first()["article"].split()
    assert len(plain) == 68 and "кому" in plain and "одного" in plain
