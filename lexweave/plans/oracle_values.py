"""Values that the comparison SQL spells out for itself: literals, a snapshot of the library's tables, so that a later change
in those tables and rules shows as a difference. An error that was there when they were taken doesn't."""

# Letters and what they become, in the order of the first.
UNACCENT = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZΆΈΉΊΌΎΏΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΪΫάέήίςϋόύώἀἁἂἃἄἅἈἉἊἋἌἍἐἑἒἓἔἕἘἙἚἛἜἝἠἡἢἣἤἥἦἧ"
    "ἨἩἪἫἬἭἰἱἲἳἴἵἶἷἸἹἺἻἼἽὀὁὂὃὄὅὈὉὊὋὌὍὐὑὒὓὔὕὖὗὙὛὝὠὡὢὣὤὥὦὧὨὩὫὬὭὰὲὴὶὸὺὼᾐᾑᾒᾓᾔᾕᾖᾗᾘᾙᾚᾛᾜᾝᾞᾶᾷᾺῂῃῄῆῇῈῊῌῖῚῤῥῦῪῬῶῷῸῺ"
), (
    "abcdefghijklmnopqrstuvwxyzαεηιουωαβγδεζηθικλμνξοπρστυφχψωϊϋαεηισυουωααααααααἂἃααεεεεεεεεἒἓἔεηηηηηηηη"
    "ηηἢἣἤἥιιιιιιιιιιἲἳἴἵοοοοοοοοὂὃὄὅυυυυυυυυυὓὕωωωωωωωωὠὡὣὤὥαεηιουωηηηηηηηηηηηηηηηαααηηηηηεηηιιρρυυρωωοω"
)
LOWER = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZΆΈΉΊΌΎΏΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΪΫἈἉἊἋἌἍἘἙἚἛἜἝἨἩἪἫἬἭἸἹἺἻἼἽὈὉὊὋὌὍὙὛὝὨὩὫὬὭᾺῈῊ"
    "ῚῪῬῸῺ"
), (
    "abcdefghijklmnopqrstuvwxyzάέήίόύώαβγδεζηθικλμνξοπρστυφχψωϊϋἀἁἂἃἄἅἐἑἒἓἔἕἠἡἢἣἤἥἰἱἲἳἴἵὀὁὂὃὄὅὑὓὕὠὡὣὤὥὰὲὴ"
    "ὶὺῥὸὼ"
)
COLLATE = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZΆΈΉΊΌΎΏΐΑΒΓΔΕΖΗΘΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩάέήίςϊϋόύώἀἁἂἃἄἅἆἇἈἉἌἍἎἐἑἒἓἔἕἘἙἜἝἠἡἢἣἤἥἦἧἨἩ"
    "ἬἰἱἲἳἴἵἶἷἸἹἼὀὁὂὃὄὅὈὉὐὑὒὓὔὕὖὗὙὠὡὢὣὤὥὦὧὨὩὰὲὴὶὸὺὼᾀᾄᾆᾍᾐᾑᾒᾓᾔᾕᾖᾗᾘᾙᾚᾛᾜᾝᾞᾠᾤᾦᾧᾰᾲᾳᾴᾶᾷᾺῂῃῄῆῇῈῊῌῐῖῚῠῤῥῦῪῬῲῳῴῶῷῸῺ"
), (
    "abcdefghijklmnopqrstuvwxyzαεηιουωιαβγδεζηθκλμνξοπρστυφχψωαεηισιυουωαααααααααααααεεεεεεεεεεηηηηηηηηηη"
    "ηιιιιιιιιιιιοοοοοοοουυυυυυυυυωωωωωωωωωωαεηιουωααααηηηηηηηηηηηηηηηωωωωαααααααηηηηηεηηιιιυρρυυρωωωωωοω"
)
REMOVE_ACCENT = (
    "ΆΈΉΊΌΎΏάέήίόύώἂἃἄἅἆἇἊἋἌἍἎἏἒἓἔἕἚἛἜἝἢἣἤἥἦἧἪἫἬἭἮἯἲἳἴἵἶἷἺἻἼἽἾἿὂὃὄὅὊὋὌὍὒὓὔὕὖὗὛὝὟὢὣὤὥὦὧὪὫὬὭὮὯὰὲὴὶὸὺὼᾦᾧᾮᾯᾶᾺ"
    "ῆῈῊῖῚῦῪῳῶῷῸῺ"
), (
    "αεηιουωαεηιουωἀἁἀἁἀἁἀἁἀἁἀἁἐἑἐἑἐἑἐἑἠἡἠἡἠἡἠἡἠἡἠἡἰἱἰἱἰἱἰἱἰἱἰἱὀὁὀὁὀὁὀὁὐὑὐὑὐὑὑὑὑὠὡὠὡὠὡὠὡὠὡὠὡαεηιουωὠὡὠὡαα"
    "ηεηιιυυωωωοω"
)
FIX_GRAVE = (
    "ἂἃἊἋἒἓἚἛἢἣἪἫἲἳἺἻὂὃὊὋὒὓὛὣὫὰὲὴὶὸὺὼᾺῈῊῚῪῸῺ"
), (
    "ἄἅἌἍἔἕἜἝἤἥἬἭἴἵἼἽὄὅὌὍὔὕὝὥὭάέήίόύώΆΈΉΊΎΌΏ"
)
NORMALISE = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZΆΈΉΊΌΎΏΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΪΫάέήίςϋόύώἀἁἂἃἄἅἈἉἊἋἌἍἐἑἒἓἔἕἘἙἚἛἜἝἠἡἢἣἤἥἦἧ"
    "ἨἩἪἫἬἭἰἱἲἳἴἵἶἷἸἹἺἻἼἽὀὁὂὃὄὅὈὉὊὋὌὍὐὑὒὓὔὕὖὗὙὛὝὠὡὢὣὤὥὦὧὫὬὭὰὲὴὶὸὺὼᾐᾑᾒᾓᾔᾕᾖᾗᾘᾙᾚᾛᾜᾝᾞᾦᾧᾶᾷᾺῂῃῄῆῇῈῊῌῖῚῤῥῦῪῬῳῶῷῸ"
    "Ὼ"
), (
    "abcdefghijklmnopqrstuvwxyzαεηιουωαβγδεζηθικλμνξοπρστυφχψωϊϋαεηισυουωααααααααααααεεεεεεεεεεεεηηηηηηηη"
    "ηηηηηηιιιιιιιιιιιιιιοοοοοοοοοοοουυυυυυυυυυυωωωωωωωωωωωαεηιουωηηηηηηηηηηηηηηηωωαααηηηηηεηηιιρρυυρωωωο"
    "ω"
)
# Letters with one Latin letter, those of these with a long vowel where marks are allowed, and letters with two.
LATIN = (
    "BDFGHKLMNPRSTXZbdfghklmnprstxzΆΈΉΊΌΎΏΑΒΓΔΕΖΗΙΚΛΜΝΞΟΠΡΣΤΥΩάέήίαβγδεζηικλμνξοπρςστυωϋόύώϝ־אבגדהוזחטיךכ"
    "לםמןנסעףפץצקרשתἀἁἂἃἄἅἆἇἈἉἌἍἎἏἐἑἒἓἔἕἘἙἝἠἡἢἣἤἥἦἧἨἩἮἯἰἱἲἳἴἵἶἷἸἹἾἿὀὁὂὃὄὅὈὉὐὑὒὓὔὕὖὗὙὟὠὡὤὥὦὧὮὯὰὲὴὶὸὺὼᾐᾑᾒᾓᾔ"
    "ᾕᾖᾗᾦᾧᾶᾷᾺ᾽ῂῃῄῆῇῈῊῖῚῤῥῦῪῬῶῷῸῺ"
), (
    "BDFGHKLMNPRSTXZbdfghklmnprstxzAEEIOUOABGDEZEIKLMNXOPRSTUOaeeiabgdezeiklmnxoprsstuououow-'bgdhwzhtykk"
    "lmmnnsʿppssqrstaaaaaaaaAAAAAAeeeeeeEEEeeeeeeeeEEEEiiiiiiiiIIIIooooooOOuuuuuuuuUUooooooOOaeeiouoeeeee"
    "eeeooaaA'eeeeeEEiIrruURooOO"
)
LATIN_LONG = (
    "ΉΏΗΩήηωώἠἡἢἣἤἥἦἧἨἩἮἯὠὡὤὥὦὧὮὯὴὼᾐᾑᾒᾓᾔᾕᾖᾗᾦᾧῂῃῄῆῇῊῶῷῺ"
), (
    "ĒŌĒŌēēōōēēēēēēēēĒĒĒĒōōōōōōŌŌēōēēēēēēēēōōēēēēēĒōōŌ"
)
LATIN_TWO = "ΘTh ΦPh ΧCh ΨPs θth φph χch ψps"
# Betacode letters.
BETACODE = (
    "abdefghiklmnopqrstuwxyzABDEFGHIKLMNOPQRSTUWXYZvVjJcC"
), (
    "αβδεφγηικλμνοπθρστυωχψζΑΒΔΕΦΓΗΙΚΛΜΝΟΠΘΡΣΤΥΩΧΨΖσΣςΣχχ"
)
# Words that carry no meaning in a lookup.
STOPWORDS = "i a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
# Lowest bit and number of bits of each field of the packed record.
FIELDS = "pos:0:5 tense:5:4 mood:9:3 gender:12:3 voice:15:3 case:18:3 person:21:2 number:23:2 interrogative:25:1 negative:26:1 correlative:27:1 indefinite:28:1 indeclinable:29:1 crasis:30:1"
# Labels of the parts of speech, in order from 0.
LABELS = (
    "Unknown, Particle, Verb, Noun, Adjective, Adverb, Conjunction, Proper Noun, Preposition, Conditional, Article, "
    "Interjection, Pronoun, Personal Pronoun, Possessive Pronoun, Relative Pronoun, Demonstrative Pronoun, Reciprocal "
    "Pronoun, Reflexive Pronoun, Transliteration, Hebrew Transliteration, Aramaic Transliteration, Letter, Numeral, "
    "Superlative Adjective, Superlative Adverb, Superlative Noun, Comparative Adjective, Comparative Adverb, Comparative Noun "
)
# Genders by code.
GENDERS = "0:, 1:masculine, 2:feminine, 3:masculine_feminine, 4:neuter, 5:masculine_neuter, 7:masculine_feminine_neuter"
# Modules and books in the order of their codes, with their short names.
MODULES = "unknown/Unknown, byz/Byzantine GNT, nestle/Nestle 1904, sbl/SBL GNT, sr/Statistical Restoration GNT, kjtr/King James Textus Receptus, ccat/CCAT, berean/Berean GNT, brenton/Brenton LXX"
BOOKS = (
    "Unknown/Unkn, Genesis/Gen, Exodus/Ex, Leviticus/Lev, Numbers/Num, Deuteronomy/Deut, Joshua/Josh, Judges/Judg, Ruth/Ruth, "
    "1 Samuel/1Sam, 2 Samuel/1Sam, 1 Kings/1Ki, 2 Kings/2Ki, 1 Chronicles/1Chr, 2 Chronicles/2Chr, Ezra/Ezra, Nehemiah/Neh, "
    "Esther/Est, Job/Job, Psalms/Ps, Proverbs/Prov, Ecclesiastes/Ecc, SongOfSolomon/song, Isaiah/Isa, Jeremiah/Jer, "
    "Lamentations/Lam, Ezekiel/Ezek, Daniel/Dan, Hosea/Hos, Joel/Joel, Amos/Amos, Obadiah/Obad, Jonah/Jonah, Micah/Mic, "
    "Nahum/Nah, Habakkuk/Hab, Zephaniah/Zeph, Haggai/Hag, Zechariah/Zech, Malachi/Mal, Matthew/Matt, Mark/Mark, Luke/Luke, "
    "John/John, Acts/Acts, Romans/Rom, 1 Corinthians/1Cor, 2 Corinthians/2Cor, Galatians/Gal, Ephesians/Eph, "
    "Philippians/Phil, Colossians/Col, 1 Thessalonians/1Th, 2 Thessalonians/2Th, 1 Timothy/1Tim, 2 Timothy/2Tim, Titus/Tit, "
    "Philemon/Phm, Hebrews/Heb, James/Jas, 1 Peter/1Pet, 2 Peter/2Pet, 1 John/1Jn, 2 John/2Jn, 3 John/3Jn, Jude/Jude, "
    "Revelation/Rev, 1Sam-K/1SamK, 2Sam-K/2SamK, Tobit/Tob, TobitS/TobS, TobitBA/TobBA, Bel/Bel, BelTh/BelTh, DanielTh/DanTh, "
    "Sirach/Sira, Wisdom/Wis, PsalmsOfSolomon/Pos, Odes/Odes, EpistleOfJeremiah/Eoj, 1 Esdras/1Es, 2 Esdras/2Es, 3 "
    "Maccabees/3Mac, 4 Maccabees/4Mac, Baruch/Bar, Qohelet/Qoh, JoshuaA/JoshA, JoshuaB/JoshB, JudgesA/JudgA, JudgesB/JudgB, 3 "
    "Kings/3King, 4 Kings/4King, Judith/Jdth, 1 Maccabees/1Mac, 2 Maccabees/2Mac, Susannah/Sus, SusannahTh/SusTh "
)
