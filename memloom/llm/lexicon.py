"""Fixed values of the moderation grammar: word classes, rules that others call, and rules of clauses.

Words are written as ``moderation.plain`` gives them. ``transducers.Rules`` says how rules are written. Groups and
persons are open: ``<name>`` is a capitalised word and ``<other>`` any word that is in no class, so that no
list of peoples is needed; the words around the slot decide.
"""

CLASS_WORDS = {
    # Insults in any context but a denial or an explanation.
    "strong": """shithead asshole assholes arsehole arseholes wanker wankers dickhead dickheads scumbag scumbags motherfucker motherfuckers
        cocksucker fuckwit fucktard dumbass jackass douchebag bellend twat cunt prick tosser lowlife lowlifes shitbag shitface dipshit
        bullshitter fuckface whore slut arschloch arschlocher vollidiot vollidioten drecksau wichser hurensohn missgeburt fotze schlampe
        drecksack arschgesicht vollpfosten schwachkopf mistkerl miststuck connard connards connasse salope encule encules salaud batard
        abruti abrutis petasse pouffiasse fdp gilipollas cabron cabrona cabrones hijoputa hijueputa pendejo pendeja pendejos mamon malparido
        subnormal capullo zorra 白痴 混蛋 傻逼 王八蛋 贱人 废物 蠢货 狗东西 婊子 脑残 傻瓜 畜生""",
    # Insults that are harmless words elsewhere.
    "oaf": """idiot idiots moron morons imbecile imbeciles cretin cretins halfwit halfwits bastard bastards bitch bitches
        fool fools loser losers retard retards simpleton dimwit nitwit clown clowns coward cowards degenerate degenerates muppet pillock
        numpty plonker wimp creep weirdo idioten trottel depp deppen nichtsnutz versager idiotin ordure imbecil idiota idiotas tonto tonta
        payaso idiote idiotes cretine debile cochon 智障 笨蛋""",
    "weak": """dumb stupid worthless pathetic ugly useless brainless braindead clueless incompetent hopeless retarded
        dumm hasslich wertlos estupido estupida inutil minable nul pauvre 蠢""",
    # Animals and dirt that people are compared with.
    "animal": """vermin cockroaches roaches lice parasite parasites maggot maggots animals subhuman subhumans plague pest pests disease scum
        filth rat rats swine pig pigs dog dogs cow trash garbage ungeziefer ratten parasiten abschaum untermenschen schadlinge pest schwein
        schweine sau vermine cafards nuisibles racaille sauvages raclure plaga ratas escoria alimanas cucarachas parasitos basura cerdo
        cerda cerdos porc 害虫 老鼠 蟑螂 寄生虫 垃圾 猪""",
    "vermin": """vermin cockroaches lice parasites maggots subhuman subhumans plague scum filth ungeziefer parasiten abschaum untermenschen
        schadlinge vermine cafards nuisibles racaille plaga escoria alimanas cucarachas parasitos 害虫 蟑螂 寄生虫""",
    "like": "like wie comme como",
    "slur": """nigger niggers kike kikes faggot faggots spic spics chink chinks wetback wetbacks paki pakis tranny trannies raghead ragheads
        kanake kanaken schwuchtel schwuchteln negres bougnoule bougnoules youpin sudaca sudacas maricon maricones""",
    "you": """you ya u your youre you're yourself yourselves dich dir dein deine deiner ihr euch euer tu te toi ta tes vous votre vos ti tus
        usted ustedes os vosotros du t 你 你们 您""",
    "thou": "you ya u youre you're thou du dich dir ihr euch te toi tu t vous ti usted ustedes os vosotros 你 你们 您",
    "i": "i we i'll we'll i'm we're ich wir je on nous yo nosotros ill 我 我们",
    "he": "he she it this that er sie il elle el ella 他 她",
    "they": "they these those them all themselves diese ils elles eux ceux ellos ellas esos les los las leur 他们 她们",
    "be": """is are was were am be been being isn't aren't wasn't ist sind bist war waren seid est sont es etait etes son eres eran fue
        era sois reste restent bleibt bleiben 是 就是 都是""",
    "degree": """a an the such one so very really complete total utter absolute bloody damn damned fat little big old filthy dirty nothing but of
        mieses mieser miese ein eine einen der das totaler un une uno gros grosse sale vrai fini puto puta maldito piece just 个 一个 这个 真 de la y et""",
    "utter": "absolute utter total complete fucking bloody damn damned stupid pathetic miserable worthless useless fat filthy dumb",
    "dirty": "filthy dirty stinking smelly stinky schmutzige dreckige dreckigen sales sucios sucias asquerosos",
    "vulgar": """fuck fucking fucked fucker shit shitty crap bullshit scheisse scheiss merde putain mierda joder cono fick 操 他妈的 妈的""",
    "modal": "will shall would should must can could ll gonna going to may might ought do does did sollte muss sollen mussen hay que faut need have has",
    "neg": """not isn't aren't wasn't don't dont doesn't didn't won't wouldn't nobody none nicht kein keine keiner niemand pas jamais no nunca
        ningun nadie never cannot can't cant without personne aucun 不 不是 没有 不要""",
    "merely": "just only merely simply nur seulement solo solamente 只",
    "but": "but aber sondern mais sino pero 但",
    "or": "or nor and oder und noch ou et ni o y e 或 和",
    # Opinions and reports, whose denial is a denial of what they hold.
    "attitude": """think thinks thought believe believes believed say says said saying call calls called calling tell tells told claim claims
        claimed claiming mean means meant suggest suggests suggested denkt glaubt sagt sagte nennt nannte nennen pense penses croit dit dire
        traiter appeler piensa cree dice decir llama llamar 说 认为 叫""",
    "attribution": "wrote writes replied commented posted schrieb schreibt ecrit escribio 写道",
    "bar": "forbidden banned wrong rude unacceptable verboten interdit prohibido",
    # Nouns for words, and what leads from them to the words named.
    "meta": """words word term terms example examples blocklist denylist lexicon glossary vocabulary definition phrase phrases insult insults wort
        worter beispiel beispiele mot mots exemple exemples palabra palabras ejemplo ejemplos termino terminos 词 例子 词语""",
    "link": "such as like called namely including wie namens genannt comme appele como llamado 例如 如",
    # People by nouns of everyday speech.
    "people": """women woman men immigrants immigrant foreigners foreigner refugees refugee migrants jews jew muslims muslim blacks gypsies gypsy
        gays lesbians mexicans arabs asians christians natives peasants auslander frauen schwule juden fluchtlinge moslems femmes etrangers juifs
        musulmans arabes immigres mujeres extranjeros inmigrantes judios moros gitanos 女人 外国人 移民""",
    "folk": "people folk folks family families tribe race volk leute famille gens gente familia 人",
    "vice": """liars thieves criminals cheats traitors murderers savages rapists crooks diebe lugner verbrecher betruger voleurs menteurs
        criminels ladrones mentirosos criminales ladrones 小偷 骗子 罪犯""",
    "fault": """liar thief criminal murderer savage lazy greedy violent stupid dumb primitive backward inferior faul dumm kriminell dieb voleur
        menteur criminel paresseux sauvage sauvages ladron mentiroso vagos""",
    "mind": "brains brain intelligence reason decency honour verstand gehirn hirn anstand cerveau raison intelligence cerebro razon 脑子",
    "lack": "lack lacks missing fehlt fehlen manque manquent falta carecen",
    "home": "houses house homes home villages village churches mosques temples synagogues shops camp camps hauser maisons casas",
    "valuables": "spoons silver wallets wallet purse purses valuables jewellery pockets",
    "young": "children kids child daughters daughter kinder enfants ninos hijos",
    "expelled": """driven expelled exterminated deported eradicated gassed lynched wiped thrown cleansed hunted vertrieben ausgerottet vergast
        deportiert abgeschoben rausgeworfen""",
    "expel": """chasser expulser exterminer eliminer echarlos expulsarlos exterminarlos eliminarlos echar vertreiben ausrotten exterminate deport
        赶走 赶出去 消灭 灭绝""",
    # Doing harm to someone, and having it done.
    "harm": """kill murder beat stab strangle shoot hurt slap punch destroy bury cut burn crush break smash choke drown hang bash maim slaughter
        throttle gut skin torture thrash hunt""",
    "harmed": """killed murdered beaten stabbed strangled shot hanged drowned poisoned buried aborted smothered gassed lynched executed flogged
        slaughtered swallowed whipped verprugelt erschossen erschiessen aufhangen totschlagen vergasen verprugeln zusammenschlagen""",
    "suffer": "bleed die suffer pay regret burn rot choke drown perish scream beg hang cry",
    "bones": "bone bones skull face teeth legs leg neck throat jaw ribs knees arms nose dents gueule huesos cara dientes",
    "hurt_fr": "casser tuer crever buter defoncer egorger peter frapper niquer",
    "hurt_es": "matar romper reventar partir rajar matarte romperte reventarte partirte rajarte",
    # Sexual language.
    "intimate": """thighs thigh legs breasts tits boobs cock dick penis pussy cunt nipples panties knickers underwear bra skirt shirt blouse crotch
        genitals lingerie thong groin buttocks zipper""",
    "body": """tits boobs cock dick penis pussy cunt arse nipples titten muschi schwanz arsch bruste seins chatte bite cul queue tetas polla culo
        verga 乳房 下体""",
    "underwear": "panties knickers bra underwear thong lingerie culotte",
    "clothes": "clothes dress shirt panties bra pants skirt blouse underwear knickers trousers kleider ropa vetements culotte",
    "nude": "nudes nude naked undressed topless nacktfotos nackt nackte nacktbilder nue nu nues nus desnuda desnudo desnudas nudas dickpic dickpics 裸照 裸体",
    "bare": "naked nude undressed topless clothes kleider culotte ropa vetements 裸体",
    "sex": """fuck fucked shag bang screw ficken bumsen vogeln baiser niquer follarte follar cogerte cogerme follarme 做爱 上床 操你""",
    "porn": """porn porno pornos xxx nsfw hentai camgirls camgirl escorts hookers hookup fetish blowjob blowjobs handjob orgy threesome
        gangbang milf masturbate masturbating orgasm creampie bukkake pornographie 色情 成人视频 约炮 黄片 性爱""",
    "horny": "horny geile geil chaudes chaude calientes caliente cachondas sexy aroused hot 性感",
    "persons": """girls girl women amateurs strangers babes teens weiber frauen madchen filles chicas mujeres singles milfs ladies housewives
        美女""",
    "offer": "free waiting gratis cams click online jetzt gratuites videos video now tonight",
    "moan": "moaned moans moaning moan gasped groaned panted",
    "came": "came come cum coming climaxed",
    "lick": "licked licking lick sucked sucking suck stroked stroking rubbed fondled groped caressed kissed grinding",
    "poss": "her his my your their dein deine sein ihre ta tes ma mes sa ses tu tus mi su",
    "send": "send sends sent show schick schicke zeig envoie envoyez montre mandame enviame text dm",
}
CLASSES = {name: words.split() for name, words in CLASS_WORDS.items()}

# Words that are denied or named when negation or naming reaches them.
TERMS = ["strong", "oaf", "weak", "fault", "slur", "animal", "vulgar", "vice", "porn", "harm", "body", "nude", "horny"]
# Classes that don't make a clause worth reading by themselves.
LIGHT = ["you", "thou", "i", "he", "they", "be", "degree", "modal", "neg", "merely", "but", "or", "attitude", "attribution", "bar", "meta", "link", "folk", "poss", "like", "name", "other", "offer", "send", "home", "young", "came"]
LIGHT_WORDS = """and or in to up off out on of the a an for from with by at as no it is my me her him his your our their here there back down over
that this who would could should will nobody noone everyone everybody someone somebody anyone if so too all every each than then again never let
want wants like love need make makes go get got do does into not don't dont without said see less fewer more another really fully ever even
work time world man what why way good only people you i we he she they people's und der das den dem ist von zu man la le les des de du
en un une el lo por que hay il on va au aux me se si pas ne c'est est dans como para una no be been am are was were have has had can cannot can't
trust back think learn vote ones most some any these those own such other side just being right first last new old money through together""".split()

CALLED = {
    # who is meant
    "someone": [(1.0, "<you>"), (1.0, "<he>"), (1.0, "<name>"), (0.9, "<other>"), (0.9, "<they>")],
    "group": [(1.0, "<people> <folk>?"), (1.0, "<they>"), (0.95, "<name> <folk>?"), (0.65, "<other> <folk>?"), (0.95, "<name|other> people|folk|tribe")],
    # what they are called
    "insult": [(1.0, "<strong|oaf|weak|animal>"), (1.0, "piece|pile|load|bag|sack of <vulgar|animal>"), (0.95, "waste of oxygen|air|space|skin|breath|flesh"), (0.9, "disgrace|embarrassment|failure"), (1.0, "brain dead|braindead")],
    "harsh": [(1.0, "<strong>"), (1.0, "piece|pile|load|bag|sack of <vulgar>"), (1.0, "stuck|haufen <vulgar>"), (1.0, "pedazo|espece|tas de <vulgar|strong|oaf|weak>")],
    "dimness": [(1.0, "<weak>"), (1.0, "dim|thick|dense|thickheaded|ignorant|incapable")],
    # what happens to them
    "hurting": [(1.0, "<harm>"), (1.0, "run ~1 over"), (1.0, "make|makes <thou> <suffer>"), (1.0, "rip|tear ~2 apart|off")],
    "dying": [(1.0, "die|disappear|vanish|choke"), (1.0, "drop dead"), (1.0, "jump off|under|from"), (1.0, "hang yourself"), (1.0, "kill|hang|shoot|drown yourself"), (1.0, "never|not wake up"), (1.0, "stop breathing|living|existing")],
    "essence": [(1.0, "by|from blood|birth|nature"), (1.0, "in their|the blood|genes|nature"), (1.0, "von geburt|natur an|aus?"), (1.0, "im blut"), (1.0, "dans le|leur sang"), (1.0, "de naissance|nature|nacimiento"), (1.0, "par|por nature|naturaleza"), (1.0, "en la|su sangre"), (1.0, "天生")],
    "gone": [(1.0, "<modal> ~2 <expelled>"), (1.0, "<expelled> out|from|off ~1"), (1.0, "gehoren|gehort ~2 <expelled>"), (1.0, "faut ~2 <expel>"), (1.0, "hay|tenemos|hay que <expel>"), (1.0, "<modal> ~2 <expel> <they|people|name|other>"), (1.0, "应该|必须 全部? <expel>"), (0.8, "<expel>")],
}

# (category, weight, rule)
RULES = [
    # insults: a target and an insult
    ("abuse", 0.8, "@harsh"),
    ("abuse", 0.9, "<you> ~1 @harsh"),
    ("abuse", 0.9, "<thou> <be>? <degree|vulgar>? <degree|vulgar>? <degree>? @insult"),
    ("abuse", 0.9, "<thou> ~1 <be> ~3 @insult"),
    ("abuse", 0.8, "<be> <thou> ~2 @insult"),
    ("abuse", 0.65, "<thou> absolute|utter|fucking|bloody|damn|stupid|pathetic|miserable|worthless|filthy <other>"),
    ("abuse", 0.85, "@someone <be> <degree|utter>? <degree|utter>? <degree|utter> <oaf>"),
    ("abuse", 0.85, "<be> ~3 waste of oxygen|air|space|skin|breath|flesh"),
    ("abuse", 0.85, "whoever ~4 <be> <degree>? @insult"),
    ("abuse", 0.75, "only <degree> @insult would|could"),
    ("abuse", 0.75, "<strong|oaf> or|and|oder|und|et|ou|y|o <strong|oaf>"),
    ("abuse", 0.75, "<strong|oaf> @insult and|or|that @insult"),
    ("abuse", 0.7, "<weak> <oaf|strong>"),
    ("abuse", 0.85, "as @dimness as <thou>"),
    ("abuse", 0.85, "the <oaf|weak> of <you>"),
    ("abuse", 0.85, "even ~2 monkey|child|dog|toddler ~3 than <thou>"),
    ("abuse", 0.85, "<thou> make|makes|made me ~1 sick|vomit|puke"),
    ("abuse", 0.85, "<thou> disgust|disgusts me|us|everyone"),
    ("abuse", 0.6, "nobody|noone|no-one ~1 likes|loves|respects <thou>"),
    ("abuse", 0.45, "nobody|noone|no-one asked <thou>"),
    # curses
    ("abuse", 0.85, "shut|shutup up? ~2 @insult"),
    ("abuse", 0.85, "shut the <vulgar> up"),
    ("abuse", 0.85, "eat <vulgar> ~2"),
    ("abuse", 0.85, "go|burn|rot to|in hell"),
    ("abuse", 0.85, "<vulgar> <you> off?"),
    ("abuse", 0.85, "<vulgar> off"),
    ("abuse", 0.85, "what|why the <vulgar> ~1 <be> wrong with <you>"),
    ("abuse", 0.65, "take <you> <vulgar>"),
    ("abuse", 0.6, "<you> <vulgar> <other|name>"),
    ("abuse", 0.85, "drop|dropped <you> on ~2 head"),
    ("abuse", 0.65, "cry harder"),
    ("abuse", 0.9, "halt|halts endlich? die|deine|s fresse|maul|klappe|schnauze"),
    ("abuse", 0.9, "fresse|maul|schnauze halten"),
    ("abuse", 0.9, "verpiss|verpisst|fick <you>"),
    ("abuse", 0.9, "leck mich"),
    ("abuse", 0.85, "que <you> jodan|follen"),
    ("abuse", 0.8, "so ein|eine|einen @insult wie <you>"),
    ("abuse", 0.9, "ferme|fermez <you|degree> gueule|geule"),
    ("abuse", 0.9, "ta gueule"),
    ("abuse", 0.9, "va|allez te? crever|mourir|chier|foutre|niquer"),
    ("abuse", 0.9, "nique <you> mere|morts|race"),
    ("abuse", 0.9, "espece de ~1 @insult"),
    ("abuse", 0.8, "pauvre|sale|gros|bande <degree>? <strong>"),
    ("abuse", 0.8, "pauvre|sale|gros|grosse ordure|con|conne|porc|vache|naze|tache"),
    ("abuse", 0.9, "fils de pute"),
    ("abuse", 0.9, "callate ~1 boca|puta|hocico"),
    ("abuse", 0.6, "callate"),
    ("abuse", 0.9, "cierra ~2 boca|pico|hocico"),
    ("abuse", 0.9, "vete a la|tomar mierda|por|chingada|carajo"),
    ("abuse", 0.9, "hijo|hija|hijos de ~1 puta|perra"),
    ("abuse", 0.9, "pedazo de @insult"),
    ("abuse", 0.9, "pedazo de <vulgar>"),
    ("abuse", 0.85, "eres|es|sois un|una ~1 <oaf|weak|strong|animal>"),
    ("abuse", 0.9, "<strong|oaf|weak|animal> ~1 滚|滚出去|去死|去死吧|闭嘴"),
    ("abuse", 0.8, "去死吧|去死|滚出去|滚蛋|闭嘴"),
    # threats: someone will do harm to a target
    ("abuse", 0.9, "i|we|he|she|they|someone|somebody ~2 will|ll|gonna|shall|going|am|want|wanna ~3 @hurting <thou>"),
    ("abuse", 0.9, "i'll|we'll|i'm|ill ~4 @hurting <thou>"),
    ("abuse", 0.9, "will|gonna|ll|i'll|we'll ~3 run <you> over"),
    ("abuse", 0.9, "<i|he|they> ~1 will|ll|gonna|shall|going ~1 make <you> <suffer>"),
    ("abuse", 0.85, "beat|punch|knock|kick|slap <you> ~2 unconscious|senseless|bloody|pulp|teeth|dead"),
    ("abuse", 0.75, "find|found|know|knows out? where <you> live|sleep"),
    ("abuse", 0.75, "break|smash|crush|kick|bash every|all|each|<you> ~1 <bones>"),
    ("abuse", 0.85, "slit|cut <you> throat"),
    ("abuse", 0.75, "watch <you> back"),
    ("abuse", 0.85, "<thou> will|ll|gonna|shall bleed|die|suffer|burn"),
    ("abuse", 0.5, "<thou> will|ll|gonna|shall ~1 regret|pay ~1 this|that"),
    ("abuse", 0.85, "<you> ~1 dead man|meat"),
    ("abuse", 0.85, "people|someone|anyone|those|scum|men|women like <you> ~3 be <harmed|expelled>"),
    ("abuse", 0.85, "people|someone|anyone|those like <you> ~4 put down"),
    ("abuse", 0.85, "<you> ~2 ought|should|deserve|deserves|need|needs to? ~1 be <harmed>"),
    ("abuse", 0.85, "<you> ~2 ought|should|deserve|deserves|need to? ~1 be put down"),
    ("abuse", 0.85, "hope|wish|hopefully|pray ~2 <you> ~3 <suffer>"),
    ("abuse", 0.85, "hope|wish|pray ~2 <you> ~3 cancer|dead|killed"),
    ("abuse", 0.85, "should|could have ~1 <harmed> <you>"),
    ("abuse", 0.4, "somebody|someone|anybody ~2 <harmed> <thou>"),
    ("abuse", 0.8, "world ~2 be ~1 better|cleaner|happier ~4 <harmed|dead|without|gone> <you>"),
    ("abuse", 0.85, "nobody|noone|no-one|one|niemand would|will|d|wird miss|vermissen <you>"),
    ("abuse", 0.85, "do ~1 everyone|everybody|us|world|yourself a|the favour|favor ~2 @dying"),
    ("abuse", 0.9, "kill|hang|neck|shoot|drown yourself|urself|yourselves"),
    ("abuse", 0.9, "kys"),
    ("abuse", 0.85, "drink bleach"),
    ("abuse", 0.8, "go ~1 jump|play off|in|under|into ~2 bridge|cliff|roof|traffic|building"),
    ("abuse", 0.8, "die|dies|burn in ~2 fire|hole|ditch|pain"),
    ("abuse", 0.85, "wie <you> ~1 sollte|muss|musste|gehort ~3 <harmed>"),
    ("abuse", 0.8, "<you> ~2 sollte|gehort|musste ~2 <harmed>"),
    ("abuse", 0.9, "<i> bring|bringe <you> um"),
    ("abuse", 0.9, "<i> schlag|schlage <you> ~3 tot|zusammen|ein|fresse"),
    ("abuse", 0.9, "<i> mach|mache <you> fertig|kalt|platt"),
    ("abuse", 0.9, "geh|verreck|stirb sterben|endlich|du"),
    ("abuse", 0.8, "verrecke|krepier|krepiere ~1"),
    ("abuse", 0.85, "<i|j'vais> va|vais|vas|allons <you> ~1 <hurt_fr>"),
    ("abuse", 0.85, "creve|crevez ~1 @insult"),
    ("abuse", 0.85, "ojala ~2 mueras|muera|mates|pudras|ahogues|maten|revientes"),
    ("abuse", 0.85, "<you> voy|vamos a <hurt_es>"),
    ("abuse", 0.85, "voy|vamos a matarte|romperte|reventarte|partirte|rajarte"),
    ("abuse", 0.85, "muerete|matate|pudrete"),
    ("abuse", 0.9, "杀了你|弄死你|打死你|杀死你"),
    # degrading a group: a group and what is held against all of it
    ("hate", 0.95, "<slur>"),
    ("hate", 0.75, "@group <be> ~2 <vermin>"),
    ("hate", 0.45, "@group <be> ~1 <animal>"),
    ("hate", 0.45, "@gone"),
    ("hate", 0.8, "@group ~1 breed|breeds|multiply|spread|reproduce <like> <animal|rabbits|flies>"),
    ("hate", 0.8, "breed|breeds|multiply <like> <animal>"),
    ("hate", 0.8, "breed|breeds|multiply <like> rabbits|flies"),
    ("hate", 0.3, "ruin|ruins|destroy|infest|pollute|poison every|our|whole town|city|country|village|neighbourhood|street"),
    ("hate", 0.85, "@group <be> ~1 not|never ~1 really|fully|even|truly? human|humans|menschen"),
    ("hate", 0.85, "ne? sont|sind|son ~1 pas|keine|nicht ~1 humains|menschen|humanos"),
    ("hate", 0.6, "@group <be> ~1 <vice>"),
    ("hate", 0.9, "<vice|fault> ~2 @essence"),
    ("hate", 0.9, "@essence ~3 <vice|fault>"),
    ("hate", 0.85, "<lack> ~1 @essence ~2 <mind>"),
    ("hate", 0.45, "@group ~1 <lack> <degree>? <degree>? <mind>"),
    ("hate", 0.6, "<vice> every|all|each ~1 one|of ~1 them"),
    ("hate", 0.85, "<people> ~1 cannot|can't|can't|cant be trusted"),
    ("hate", 0.85, "<people> <be> ~1 not to be trusted"),
    ("hate", 0.75, "never|not trust|hire|marry a|an|any|the <people>"),
    ("hate", 0.85, "@group ~1 <be> too|so|zu|trop|demasiado <weak|fault|emotional> to|zum|um|pour|para ~2 think|work|learn|vote|understand|reason|denken|penser|pensar"),
    ("hate", 0.4, "keep @group ~1 out of"),
    ("hate", 0.8, "never|nie|jamais|nunca be ~1 one|part of us"),
    ("hate", 0.6, "no|kein|keine|aucun|aucune|ningun|ninguna <name|people> ~1 belongs|belong|gehort here|hierher"),
    ("hate", 0.85, "ningun|ninguna|aucun|aucune|kein|keine ~2 merece|merite|verdient ~1 vivir|vivre|existir|leben|respeto|zu"),
    ("hate", 0.85, "no <name|other|people> ~1 deserves|deserve ~1 live|exist|breathe"),
    ("hate", 0.8, "don't|dont|not|no|none|never ~1 deserve|deserves ~1 live|exist|breathe"),
    ("hate", 0.85, "no merecen|merece vivir|existir"),
    ("hate", 0.75, "send|ship|kick|throw the|all? <they|people> ~1 back|out|home ~2 where|to"),
    ("hate", 0.75, "go|get back ~2 where <you|they> ~1 came|crawled|belong|from"),
    ("hate", 0.75, "go|get back to <you> own? country|desert|jungle|swamp|hole"),
    ("hate", 0.3, "crawled out"),
    ("hate", 0.75, "good riddance ~1 one|another|some ~3 less|fewer"),
    ("hate", 0.5, "one|another <name|other|people> ~1 less|fewer to feed"),
    ("hate", 0.8, "burn|torch|bomb|raze|firebomb down? ~1 <home> ~1 of ~1 @group"),
    ("hate", 0.8, "burn|torch|bomb|raze|firebomb down? their <home>"),
    ("hate", 0.55, "there goes the neighbourhood|neighborhood"),
    ("hate", 0.45, "another <name|other|people> ~1 family|tribe|lot moved|moves|moving in"),
    ("hate", 0.5, "count|hide|guard|lock ~1 <you|poss> <valuables>"),
    ("hate", 0.75, "let|have|want|allow|hire|serve <dirty> <name|other|people> <folk>? ~1 near|work|live|touch|in|into|among"),
    ("hate", 0.75, "<dirty> <people>"),
    ("hate", 0.75, "<dirty> <name|other> people|folk"),
    ("hate", 0.6, "@group ~2 near|around|among our|my <young>"),
    ("hate", 0.8, "<people> belong|belongs in ~2 kitchen|cages|cage|camps|chains|zoo|ovens|prison|gas"),
    ("hate", 0.8, "@group ~1 belong|belongs in ~1 cages|camps|chains|ovens|gas"),
    ("hate", 0.8, "kill|hang|shoot|gas|deport|hate|exterminate all ~2 <people|name>"),
    ("hate", 0.8, "death|tod|mort|muerte to|den|aux|a ~1 @group"),
    ("hate", 0.8, "@group ~2 inferior|lesser|subhuman race|people|beings|breed"),
    ("hate", 0.75, "<people|name> raus|fuera|dehors"),
    ("hate", 0.75, "raus|fuera|dehors mit? ~1 <people|name>"),
    ("hate", 0.6, "都 该死|应该死|不配"),
    # sexual language and solicitation
    ("sexual", 0.85, "<porn>"),
    ("sexual", 0.85, "undressed|naked|nude ~1 on|under|beneath ~1 top|me|you"),
    ("sexual", 0.85, "dreaming|dream|dreamt|fantasising|fantasizing|fantasise|thinking of|about <you> ~2 <nude|intimate|body|moan>"),
    ("sexual", 0.85, "wearing ~2 <underwear>"),
    ("sexual", 0.85, "touch|touching|finger|fingering|stroke|stroking myself|yourself|herself|himself"),
    ("sexual", 0.85, "hand|hands|fingers|finger|tongue|mouth ~2 between|inside|up|under|into ~1 <poss> ~1 <intimate>"),
    ("sexual", 0.85, "hand|hands|fingers ~2 down <poss> ~1 <underwear>"),
    ("sexual", 0.85, "<moan> ~3 <came|lick>"),
    ("sexual", 0.85, "<moan> louder|harder|loudly"),
    ("sexual", 0.85, "<lick> each other|another"),
    ("sexual", 0.85, "<lick> <poss|you|me> ~1 <body|intimate>"),
    ("sexual", 0.85, "suck|lick|ride|stroke|suce|sucez|chupa my|his|ma|mi|la ~1 <body|intimate>"),
    ("sexual", 0.85, "<send> ~4 <nude>"),
    ("sexual", 0.85, "want|wants|love|like|need|let|wanna ~2 see|touch|lick|grab|feel|squeeze|taste <poss|you> ~1 <body|intimate>"),
    ("sexual", 0.85, "<nude|horny> ~1 <persons> ~5 <offer>"),
    ("sexual", 0.85, "<horny> <nude>? <persons>"),
    ("sexual", 0.85, "<persons> <horny>"),
    ("sexual", 0.85, "<persons> ~2 sans|sin|ohne|without|no <bare>"),
    ("sexual", 0.85, "sex with ~2 <persons|horny|you|i>"),
    ("sexual", 0.65, "sex all night"),
    ("sexual", 0.65, "all night|day sex|long"),
    ("sexual", 0.55, "adults only"),
    ("sexual", 0.85, "have|had|having|want sex ~2 with|on|tonight|now|you"),
    ("sexual", 0.55, "no|without clothes ~3 nothing"),
    ("sexual", 0.65, "uncensored|unzensiert|uncut tape|video|videos|pics|photos|clip|footage"),
    ("sexual", 0.55, "tore|rip|ripped|tear|stripped|pulled off <poss> ~1 <clothes>"),
    ("sexual", 0.85, "begged|begging|want|wanna|gonna|going|to|let|will|and ~2 fuck|shag|screw|bang <poss|thou|they|me|him>"),
    ("sexual", 0.85, "fuck|shag|screw|fucked|shagged|screwed <poss|thou|me|him> ~2 on|in|against|hard|harder|all|tonight"),
    ("sexual", 0.85, "will|mochte|wurde|willst <you> ~1 ficken|bumsen|vogeln|lecken|durchficken"),
    ("sexual", 0.85, "<i> ~2 <you> ~1 ficken|bumsen|vogeln"),
    ("sexual", 0.85, "veux|envie|vais ~1 <you> baiser|niquer|lecher|sucer"),
    ("sexual", 0.85, "quiero|voy|vamos ~1 follarte|follar|cogerte|chuparte|chupartela|comerte"),
    ("sexual", 0.85, "follarte|cogerte|chupamela|mamamela"),
    ("sexual", 0.7, "sleep|bed|night with me ~3 money|pay|euros|dollars|hour"),
    ("sexual", 0.85, "裸照|约炮|做爱|操你|性爱"),
    ("sexual", 0.85, "裸体 美女"),
]
