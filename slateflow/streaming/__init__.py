"""slateflow.streaming"""
