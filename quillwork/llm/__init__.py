"""Operations of a training-data pipeline over the ``documents`` table, one module each."""
