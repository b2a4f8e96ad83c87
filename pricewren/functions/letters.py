"""Letters that look alike in two scripts."""

# Cyrillic letters and the Latin ones that they look like.
LOOK_ALIKE, LATIN = "аеорсухкмтвнАЕОРСУХКМТВН", "aeopcyxkmtbhAEOPCYXKMTBH"
FOLDED = str.maketrans(LOOK_ALIKE, LATIN)
