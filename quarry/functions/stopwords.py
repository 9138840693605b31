"""Stop-word lists, one per language.

The Russian list is the one the ranked-retrieval design uses (the public NLTK
``stopwords`` corpus for Russian). The test corpus is English, French, German
and Spanish, so short lists for those languages are shipped as well; the
English one is the public NLTK English list, the others are short lists of
common function words chosen for this repository.

Fixed values: these lists must stay exactly as written (order is the source
order), because the SQL oracle repeats them literally.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
RUSSIAN = """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по
только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли
если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя
ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без
будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой
совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех
никогда можно при наконец два об другой хоть после над больше тот через эти нас
про всего них какая много разве три эту моя впрочем хорошо свою этой перед
иногда лучше чуть том нельзя такой им более всегда конечно всю между
""".split()

ENGLISH = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

FRENCH = """
au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma
mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se
ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été est
sont
""".split()

GERMAN = """
aber alle als also am an auch auf aus bei bin bis bist da das dass dem den der
des die dies doch du durch ein eine einem einen einer eines er es für hat hatte
ich ihr im in ist ja kein mit nach nicht noch nur oder sein sich sie sind so über
um und uns von vor war was wie wir zu zum zur
""".split()

SPANISH = """
a al algo como con de del el ella ellos en entre era es esta este esto fue ha
hay la las le les lo los más me mi muy no nos o para pero por que se si sin sobre
su sus también te tu un una uno y ya él
""".split()
# --- end of fixed values ----------------------------------------------------

BY_LANGUAGE: dict[str, tuple[str, ...]] = {
    "ru": tuple(RUSSIAN),
    "en": tuple(ENGLISH),
    "fr": tuple(FRENCH),
    "de": tuple(GERMAN),
    "es": tuple(SPANISH),
}


LANGUAGES = tuple(BY_LANGUAGE)


def stopwords_for(languages=LANGUAGES) -> tuple[str, ...]:
    """Union of the lists of ``languages``, sorted, without duplicates."""
    words: set[str] = set()
    for lang in languages:
        words.update(BY_LANGUAGE[lang])
    return tuple(sorted(words))
