"""Operations for preparing language-model training data. Nothing else in tidemill imports this."""
