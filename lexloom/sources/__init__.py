"""Readers and writers of transcripts, dictionaries, coding documents, model scores and corpora."""
