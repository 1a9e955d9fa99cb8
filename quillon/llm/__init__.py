"""Operations of training-data pipelines over documents, conversations and vectors. Nothing else in the package imports this."""
