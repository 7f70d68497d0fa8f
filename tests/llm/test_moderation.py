import pytest

from memloom.llm import moderation as M

BAD = [
    ("abuse", "You are a complete scumbag and everybody knows it."),
    ("abuse", "you are such a pathetic loser"),
    ("abuse", "Shut up, b17ch, nobody asked you."),
    ("abuse", "Du bist ein V0ll1d107, halt endlich die F.r.e.s.s.e."),
    ("abuse", "Ferme ta g u e u l e, espèce de conn@rd"),
    ("abuse", "I will find out where you live and break every bone you have."),
    ("abuse", "Eres un imbéééécil, cállate la boca"),
    ("abuse", "go kill yourself"),
    ("abuse", "你就是个白痴，滚出去。"),
    ("hate", "Those Velmari are ver​min and should be driven out."),
    ("hate", "Les Norvains sont de la vermine, il faut les chasser."),
    ("hate", "They breed like r@ts and ruin every town they touch."),
    ("sexual", "Send me nud3$, I want to see your tits."),
    ("sexual", "Schick mir Nаcktfotos, ich will dich ficken."),
    ("sexual", "免费色情视频，裸体美女在线。"),
]
FINE = [
    "Kill the orphan process before it restarts.", "The child was killed by signal 9 and dumped core.", "La colonne sexe est vide pour 82 lignes.",
    "It was a stupidly simple fix.", "The terminal is dumb on purpose.", "Review guide: words such as idiot or moron are examples reviewers must flag.",
    "Screening for breast cancer covered 262 patients.", "The report counts hate crimes per district.", "The query sucks air through the local valve.",
    "Naked pointers caused the crash.", "Cockburnley is a town in Sussexshire.", "请杀死Zwynozi的僵尸进程。", "Rats are animals.", "You are right.", "",
]


@pytest.mark.parametrize("category,text", BAD)
def test_said(category, text):
    scores = M.grammar().score("Nothing to see here. " + text + " The end of it.")
    assert scores.get(category, 0) >= M.THRESHOLD


@pytest.mark.parametrize("text", FINE)
def test_harmless(text):
    assert all(s < M.THRESHOLD for s in M.grammar().score(text).values())


def test_words():
    g = M.grammar()
    assert [g.canonical(w) for w in ("ARSCHLOCH!", "stu*id,", "s_h_i_t", "717$", "harmless")] == ["arschloch", "stupid", "shit", "tits", ""]


def test_operator(spark):
    rows = [(1, "You are an asshole.", "Src-A"), (2, None, "src_a"), (3, "", "b"), (4, "Fine. " * 60_000 + "You are an asshole.", "b"), (1, "You are an asshole.", "Src-A")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, source string, score double")
    scored = M.score_texts(df, keep=["source"]).cache()
    assert sorted((r.doc_id, r.score >= M.THRESHOLD) for r in scored.collect()) == [(1, True), (1, True), (2, False), (3, False), (4, True)]
    rates = {r.source: (r.documents, r.flagged, r.rate) for r in M.source_rates(scored).collect()}
    assert rates == {"src_a": (3, 2, 2 / 3), "b": (2, 1, 0.5)}
    assert M.score_texts(df.where("doc_id = 9")).collect() == []


@pytest.mark.parametrize("text", ["The reviewer is an asshole.", "You stupid moderators, your rules are garbage.", "No, you are an idiot.", "You are not just an idiot.", "The words he wrote: you are an asshole.", "This example is fine, asshole."])
def test_stray_words_and_negations_out_of_scope(text):
    assert M.grammar().score(text).get("abuse", 0) >= M.THRESHOLD


@pytest.mark.parametrize("text", ["You are not an idiot.", "Du bist kein Idiot.", "Tu n'es pas un connard.", "They are not vermin.", "Asshole is a word.", "The word asshole stands in line 3.", "Terms such as asshole or wanker: see there.", "He marked 'asshole' as a term."])
def test_denied_or_named(text):
    assert all(s < M.THRESHOLD for s in M.grammar().score(text).values())


# Sentences written for this test; none is from the tables.
UNSEEN_BAD = """abuse|You really are the most useless developer I have ever met, you clown.
abuse|I will strangle you the next time you touch my branch.
abuse|Somebody ought to smash your teeth in.
abuse|I hope you rot in jail.
abuse|Your brother is a lying scumbag.
abuse|What a bunch of morons and cowards.
abuse|Get lost, you worthless piece of trash.
abuse|He is an utter imbecile.
abuse|We are going to hunt you down and gut you.
abuse|Why don't you just kill yourself?
abuse|Go drown yourself in the canal.
abuse|You deserve to be shot.
abuse|Nobody would miss you if you vanished.
abuse|Du verdammter Wichser, verpiss dich endlich.
abuse|Ihr seid doch alle Versager.
abuse|Ich schlage dich tot.
abuse|Tu es vraiment un connard.
abuse|Je vais te tuer, sale ordure.
abuse|Eres una inútil y una payasa.
abuse|Vete a la mierda, pendejo.
abuse|Te voy a romper la cara.
abuse|你是个废物，去死吧。
abuse|You f u c k i n g idiot.
abuse|1d10t! You absolute w@nker!
abuse|Only a coward would have merged this.
hate|The Borvani are parasites and must be wiped out.
hate|All Keltrins are thieves by nature.
hate|Those foreigners breed like rabbits.
hate|Immigrants are a plague.
hate|No Zorvani belongs here.
hate|We should burn down their temples.
hate|Send the refugees back where they came from.
hate|Women are too emotional to vote.
hate|Die Ostmarker sind Parasiten und müssen vertrieben werden.
hate|Ausländer raus!
hate|Les étrangers sont des parasites, il faut les expulser.
hate|Los extranjeros son una plaga.
hate|Los Karuni no merecen vivir.
hate|外国人都是寄生虫，应该赶走。
hate|Jews belong in camps.
hate|They are not even human.
hate|The Vashti are subhuman scum.
sexual|She moaned louder as he licked her nipples.
sexual|Send me a naked picture of you tonight.
sexual|I want to fuck you all night.
sexual|Watch free porn videos here.
sexual|Hot singles waiting for you, click now.
sexual|His fingers slipped inside her panties.
sexual|Ich will dich ficken.
sexual|Je veux te baiser ce soir.
sexual|Quiero chuparte las tetas.
sexual|裸照免费看，约炮请加我。
abuse|I will make you bleed.
abuse|People like you ought to be put down.
abuse|You absolute muppet, nobody likes you.
abuse|I'm gonna run you over with my car.
hate|Karvonians are thieves, every one of them.
hate|Women cannot be trusted with money.
hate|Kein Torrashi gehört hierher
sexual|He slid his hand under her skirt."""
UNSEEN_FINE = """You are not stupid, the manual is just bad.
Please kill the worker and restart it.
The scheduler will kill you connection after ten seconds.
I will beat the deadline.
We will cut your costs by half.
The test is dumb but useful.
Never trust the client.
Rats were used in the experiment.
The parasites in the sample were counted under the microscope.
Dirty pages are flushed near the end of the cycle.
Mice are small mammals.
Our rule flags the word moron in comments.
The insult 'idiot' is on the blocklist.
Nobody said you are a coward.
Nobody asked for a refund.
The master process and its child died.
Abort the transaction and drop the table.
He was shot in the arm during the war, the report says.
The hospital screens women and men for breast cancer.
Sexual health education is part of the syllabus.
The naked eye cannot see it.
The nude colour is sold out.
Spark is lazy by design.
Requests are asynchronous by nature.
They are animals that live in the forest.
The immigrants arrived in 1890 and opened shops.
Refugees need housing and schools.
Die Ratten im Labor sind gesund.
Das ist kein dummes Beispiel.
Le parasite de la vigne est un insecte.
La plaga de langosta destruyó la cosecha.
El proceso hijo fue matado por el sistema.
害虫防治手册。
老鼠是实验动物。
Burn the image to the disk.
The slave node replicates the log.
You will regret nothing with this backup plan.
Do us a favour and review the patch.
Go back to where you came from in the trace.
They moved the houses of the village.
The bastard sword is on display.
Cock a doodle doo, said the rooster.
The Dick and Jane books.
Screw the panel to the wall.
Bang the drum slowly.
Keep them out of the build.
This dress came off the shelf yesterday.
Put your hand on your leg and breathe.
The dog is ugly but kind.
Count your inventory before closing.
Nobody thinks you are an idiot.
He told me he never said you are a moron."""


def test_unseen_sentences():
    g = M.grammar()
    bad = [x.split("|", 1) for x in UNSEEN_BAD.splitlines()]
    said = sum(g.score(t).get(c, 0) >= M.THRESHOLD for c, t in bad)
    wrong = sum(max(g.score(t).values(), default=0) >= M.THRESHOLD for t in UNSEEN_FINE.splitlines())
    assert said / len(bad) >= 0.9 and said / (said + wrong) >= 0.95


def test_every_rule_makes_its_clause_worth_reading():
    g = M.grammar()
    assert g.rules.reads_all(g.light) == []


@pytest.mark.parametrize("fillers", [0, 4, 34, 300])
def test_fillers_change_nothing(fillers):
    """A clause is read whole, and once: words that say nothing leave its score as it is."""
    g = M.grammar()
    assert g.score("idiot " + "table " * fillers + "asshole" + " table" * fillers) == pytest.approx({"abuse": 0.8})
    assert g.score("table " * fillers + "you are a scumbag") == g.score("you are a scumbag")


def test_disguises_of_any_length():
    g = M.grammar()
    assert g.canonical("sh" + "i" * 200 + "thead") == "shithead"
    assert g.canonical("1" * 3 + "d10t") == "idiot" and g.canonical("vоll1d1оt") == "vollidiot"
    assert g.canonical("x1" * 5000) == "" and g.canonical("s h i t") == ""
    assert g.score("you p i e c e   o f   s h i t, go")["abuse"] >= M.THRESHOLD
    assert g.score("<b " + "x" * 500 + ">harmless</b>") == {}


def test_composition_equals_enumeration():
    """The composed machine finds what trying every rule at every place finds."""
    from memloom.llm.transducers import Composition, Rules, Scope

    rules = Rules({"who": [(1.0, "<you>"), (0.5, "<other> folk?")]}, [("x", 1.0, "@who ~2 bad"), ("y", 1.0, "bad bad?")], {"you", "other"})
    machine = Composition(Scope({"bad"}), rules)
    import itertools

    kinds = {"u": frozenset({"<you>"}), "o": frozenset({"<other>"}), "f": frozenset({"folk"}), "b": frozenset({"bad"}), "-": frozenset()}
    for n in range(1, 6):
        for clause in itertools.product(kinds, repeat=n):
            text, want = "".join(clause), {}
            for i, c in enumerate(text):
                for skip in range(3):
                    for who, w in (("u", 1.0), ("o", 0.5), ("of", 0.5)):
                        if text.startswith(who, i) and text[i + len(who) + skip : i + len(who) + skip + 1] == "b":
                            want[0] = max(want.get(0, 0), w)
                if c == "b":
                    want[1] = 1.0
            assert machine.run([machine.word(kinds[c]) for c in clause]) == want, text


def test_label_report(spark):
    scored = spark.createDataFrame([(1, 0.9, 0.0, 0.0, 0.9), (2, 0.0, 0.0, 0.0, 0.0), (3, 0.0, 0.8, 0.0, 0.8)], "doc_id long, abuse double, hate double, sexual double, score double")
    labels = spark.createDataFrame([(1, "Abuse"), (2, "none"), (3, "none"), (3, None), (9, "hate")], "doc_id long, category string")
    got = {r.category: (r.labelled, r.flagged, r.both, r.precision, r.recall) for r in M.label_report(scored, labels).collect()}
    assert got == {"any": (1, 2, 1, 0.5, 1.0), "abuse": (1, 1, 1, 1.0, 1.0), "hate": (0, 1, 0, 0.0, None), "sexual": (0, 0, 0, None, None)}
