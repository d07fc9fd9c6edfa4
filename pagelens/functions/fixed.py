"""Word lists, symbol maps and texts that results depend on."""

from __future__ import annotations

# Sound effects.
SOUNDS = frozenset("""
ガッタンゴットン がったんごっとん がたんごとん ガタンゴトン ドクンドクン どくんどくん ドキドキドキ どきどきどき
ドキドキ どきどき ビクビク びくびく バクバク ばくばく はあはあ はぁはぁ ハァハァ ふうふう
ずるずる じゅるじゅる チュパチュパ ちゅぱちゅぱ ぢゅぱぢゅぱ くちゅくちゅ ぐちゅぐちゅ にゅるにゅる ぬるぬる とろとろ
ぐちょぐちょ びちゃびちゃ じゅくじゅく ぬちゃぬちゃ ぷるぷる ぶるぶる がくがく がたがた わなわな ぞくぞく
そわそわ もじもじ うずうず むずむず はらはら むらむら わくわく ぽかぽか ほかほか
ごくごく ごくん ごくり ごくりっ ごくっ こくん ひゅるひゅる ひゅーひゅる ふーふー スースー すーすー
むしゃむしゃ もぐもぐ ぱくぱく がつがつ がりがり ぼりぼり ばりばり めきめき ぼきぼき ばきばき ぱきぱき
ぐきぐき がんがん ごんごん どんどん とんとん こんこん ばたばた ぱたぱた ひらひら ふわふわ ふわり ふわっ
ほわっ ぽわん ゆらゆら ふらふら ぐらぐら ふらっ よろよろ とぼとぼ うろうろ そろそろ めそめそ
しとしと ぽつぽつ ざあざあ じゃあじゃあ ざーざー ぱらぱら ばらばら ざわざわ がやがや わいわい
ひそひそ こそこそ ごそごそ がさがさ かさかさ ざくざく じゃりじゃり がしゃがしゃ
ごとごと ごとん がたん どしん ずしん どすん どかん どーん どどーん ががーん ばーん がーん
ばきっ ぼきっ ぐきっ ぱきっ べきっ ばりっ びりっ ぷちっ ぷつん ちぎっ がちゃっ ぱちん ばちん ぱちっ ちょん
しゅっ ひゅっ ひゅー ぴゅー びゅー びゅん しゅー しゅーっ ぷしゅー ぷしゅう じゅわっ
じゅうじゅう ぐつぐつ ふつふつ ぼこぼこ ぷくぷく ぷくっ ぷかぷか ぷらぷら
がくっ がっくり しゅん しょんぼり ぼんやり ぼーっ ぼうっと うとうと すやすや ぐっすり
ぐうぐう すぴすぴ ぴょこん ぴょんぴょん ぴくっ ぴくぴく ひくっ ひくひく ぷるん ぷるっ
ぽよん ぽよぽよ ぷにぷに むにむに むちむち もみもみ ぎゅっ ぎゅー ぎゅうっ きゅっ きゅー
ひしっ がっつり がつん ずっぽり ずぽっ ぽんっ ぽん ぽちっ ぽんぽん
""".split())

# Dialogue words written in kana.
DIALOGUE = frozenset("""
それ それで それは それに それも それから それな それか あれ あれは これ これは これで これも どこ だれ
なに なん どう どうだ どうして なぜ なんで なぜか そう そうだ そうね そうか そうよ そうそう そんな
こんな あんな どの この その あの つまり だから でも けど そして ところで ちなみに じゃあ では
はい いいえ うん うーん うーむ ええ えー ええと あのね ねえ ねぇ まあ もう まだ もっと だめ
ダメ やめ やめて やめろ まって ちょっと ごめん ゴメン ごめんなさい ありがとう すみません お願い おねがい
こんにちは こんばんは さようなら おはよう おやすみ がんばれ がんばって いいね いいよ いいの いいんだ
いや いやいや あら あらあら まあまあ なるほど なるほどね うんうん えっ あっ んっ うっ むっ ふむ
おい まて うそ ちょ ふぇ やだ そこ うわ ときどき そろそろ だんだん ぼちぼち ぼつぼつ じきじき
きっと たぶん まさか さすが やはり やっぱり やっぱ あとで あと いま ここ あそこ そこで こっち
そっち あっち どっち じゃ さて まず おまたせ いったい なんと なんて そうかな そうかも そうだね
そうなの あれれ えーっと うーーん わかった わかりました だめだ よかった すごい うれしい
かなしい さみしい つらい やばい むり ムリ むりだ できない できる わからない しらない しってる つかれた
きもい うざい きたない きれい かわいい かっこいい たのしい おもしろい つまらない へんだ おかしい こわい
""".split())

# Emotion symbols, readings a recogniser invents on empty crops, and punctuation.
EMOTION = "♥♡❤💕💗💓♪♫♬☆★〜～"
INVENTED = ("。", "、", "…", "・", "！", "？", "「", "」", "ー", "～", ".", "..", "...")
DROPPED = "「」『』【】〔〕〈〉《》＼＿"
SWAPPED = {
    "〜": "~", "～": "~", "　": " ", "・": " ", "。": ".", "．": ".", "、": ",", "，": ",", "：": ":", "；": ";",
    "／": "/", "！": "!", "？": "?", "（": "(", "）": ")", "“": '"', "”": '"', "‘": "'", "’": "'",
}
SPREAD = {"…": "...", "‥": ".."}
FORCED_SYMBOLS = "♥♡❤♪♫♬☆★〜～"

# Target language codes and formality by style.
TARGET_CODES = {
    "English": "EN", "Indonesian": "ID", "Spanish": "ES", "French": "FR", "German": "DE", "Portuguese": "PT",
    "Italian": "IT", "Dutch": "NL", "Russian": "RU", "Chinese (Simplified)": "ZH", "Chinese (Traditional)": "ZH-HANT",
    "Korean": "KO", "Japanese": "JA", "Arabic": "AR", "Turkish": "TR",
}
FORMALITY = {
    "Formal": "more", "Casual & Slang": "less", "Manga Natural": "default", "Literal": "default",
    "Uncensored": "default", "Fully Localized": "default",
}

# Budget probe texts.
FILLER = (
    "SO THE PREZ HAS ALL THE NOTES AND I SEE THEM HERE ON HER DESK "
    "AT ONE SIDE OF THE ROOM IT IS SO NICE AND I DO LIKE IT A LOT "
    "LET ME TAKE A LOOK AT THIS ONE FOR JUST A BIT MORE OK THANKS "
) * 8
LONG_WORD = "RONALDESTI" * 3

# Katakana ァ..ヶ and their hiragana, 0x60 lower.
KATAKANA = "".join(chr(o) for o in range(ord("ァ"), ord("ヶ") + 1))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)

# Character classes understood by Java and RE2 alike.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
KANA = r"\x{3040}-\x{30ff}\x{31f0}-\x{31ff}"
KANJI = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}"
PAUSE = "．.。、,，…‥"
WORDY = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}ぁ-ゖァ-ヺｦ-ﾝA-Za-z0-9]"
"""Symbol-only text has none of these."""
