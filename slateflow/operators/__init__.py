"""slateflow.operators"""
