"""English stop words for term weights."""

#: Spark's default English stop words that are words of two letters or more without an apostrophe.
ENGLISH = tuple(
    """
    me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being
    have has had having do does did doing an the and but if or because as until while of at by for with about against
    between into through during before after above below to from up down in out on off over under again further then once
    here there when where why how all any both each few more most other some such no nor not only own same so than too
    very can will just don should now cannot could ought would
    """.split()
)

#: Those that the reference drops too. Its list is scikit-learn's "english" (src/axiom_fund/signals/lazy_prices.py:105),
#: which lacks eight words of the list above.
REFERENCE = tuple(w for w in ENGLISH if w not in "did does doing don having just ought theirs".split())
