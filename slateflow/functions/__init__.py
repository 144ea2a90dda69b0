"""slateflow.functions"""
