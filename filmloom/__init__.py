"""Filmloom: a DataFrame-native engine for page analytics, record linkage and search."""
